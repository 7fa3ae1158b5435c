"""Minute bars stored once, cut by (market, source, day), so that lookups come to them and the bars stay where they lie."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hot import attach
from tidemark.session import stage_folder, staged

KEY = ["market_id", "source", "day"]
#: bars in a bucket
PER_BUCKET = 2_000_000
_DAY = 86400


@dataclass(frozen=True)
class History:
    """``points`` (market_id, source, day, ts, mid_price) is a table bucketed by its first three columns and sorted in each bucket: a hot
    market is spread by days, and a join on these columns reads it without an exchange. ``days`` has the first and last bar and
    the number of bars of each (market_id, source, day)."""

    points: DataFrame
    days: DataFrame


def store(points: DataFrame, n_rows: int) -> History:
    """Write minute bars (market_id, source, ts, mid_price), one per key and minute; ``n_rows`` bounds their number and sets that of buckets."""
    spark = points.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-n_rows // PER_BUCKET))
    name, path = f"tidemark_bars_{uuid.uuid4().hex}", stage_folder(spark) + "/t"
    bars = points.select("market_id", "source", F.floor(F.unix_seconds("ts") / _DAY).cast("bigint").alias("day"), "ts", "mid_price")
    (bars.repartition(buckets, *KEY).write.format("parquet").option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY, "ts").saveAsTable(name))
    stored = spark.table(name)
    bar = F.struct(F.col("ts").alias("_ts"), F.col("mid_price").alias("_v"))
    days = stored.groupBy(*KEY).agg(F.min(bar).alias("_first"), F.max(bar).alias("_last"), F.count(F.lit(1)).alias("n"))
    return History(stored, staged(days))


def neighbours(asked: DataFrame, history: History, t: str) -> DataFrame:
    """Rows of ``asked`` (market_id, source, ``t`` and others) with ``prev``, the last bar at or before ``t``, and ``next``, the first at or after it.

    Bars of the same day are met by an equality of the bucketed columns; other days by their first and last bar, carried over one row per
    (market, source, day).
    """
    cols = asked.columns
    placed = asked.withColumn("day", F.floor(F.unix_seconds(t) / _DAY).cast("bigint"))
    bar = F.struct(F.col("ts").alias("_ts"), F.col("mid_price").alias("_v"))
    same = (placed.join(history.points, KEY)
            .groupBy(*cols).agg(F.max(F.when(F.col("ts") <= F.col(t), bar)).alias("prev"), F.min(F.when(F.col("ts") >= F.col(t), bar)).alias("next")))
    wanted = placed.select(*KEY).distinct()
    days = history.days.select(*KEY, "_first", "_last").join(wanted.select("market_id", "source").distinct(), ["market_id", "source"], "left_semi")
    line = (days.unionByName(wanted, allowMissingColumns=True).groupBy(*KEY).agg(F.max("_first").alias("_first"), F.max("_last").alias("_last")))
    w = Window.partitionBy("market_id", "source")
    up = w.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    down = w.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    line = line.select(*KEY, F.last("_last", ignorenulls=True).over(up).alias("prev"), F.last("_first", ignorenulls=True).over(down).alias("next"))
    other = attach(placed, line, KEY, "left").select(*cols, "prev", "next")
    return same.unionByName(other).groupBy(*cols).agg(F.max("prev").alias("prev"), F.min("next").alias("next"))

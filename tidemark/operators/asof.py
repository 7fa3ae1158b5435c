"""Time lookups: nearest, first at or after, last at or before.

``lookups`` is a narrow table whose rows are unique; ``facts`` holds at most one row per
(key, minute), so every bucket below has a fixed size limit and no key is gathered in one task.
Each function returns the lookup rows plus the found ``ts`` and ``value`` (NULL when none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hot import attach

_DAY = 86400


def _bucket(c: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(c) / F.lit(width)).cast("long")


def _facts(facts: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return facts.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(value).alias("_v"))


def _unpack(df: DataFrame, cols: list[str], value: str) -> DataFrame:
    return df.select(*cols, F.col("_hit._ts").alias(f"{value}_ts"), F.col("_hit._v").alias(value))


def nearest_within(lookups: DataFrame, facts: DataFrame, key: str, t: str, ts: str, value: str,
                   tolerance_min: int) -> DataFrame:
    """Fact nearest to the minute of ``t`` within the tolerance; a tie goes to the earlier fact."""
    tol, width = tolerance_min * 60, max(tolerance_min * 120, 60)
    cols = lookups.columns
    floor_t = F.date_trunc("minute", F.col(t))
    sec = F.unix_seconds(floor_t)
    spans = F.array_distinct(F.array(F.floor((sec - tol) / width), F.floor((sec + tol) / width)))
    left = lookups.withColumn("_sec", sec).withColumn("_b", F.explode(spans.cast("array<bigint>")))
    right = _facts(facts, key, ts, value).withColumn("_b2", _bucket(F.col("_ts"), width))
    gap = F.abs(F.unix_seconds("_ts") - F.col("_sec"))
    hit = (left.join(right, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")) & (gap <= tol), "left")
           .groupBy(*cols)
           .agg(F.min_by(F.struct("_ts", "_v"), F.when(F.col("_ts").isNotNull(), F.struct(gap, F.col("_ts"))))
                .alias("_hit")))
    return _unpack(hit, cols, value)


def first_at_or_after(lookups: DataFrame, facts: DataFrame, key: str, t_lo: str, t_hi: str, ts: str,
                      value: str, fact_key: str | None = None) -> DataFrame:
    """First fact in [t_lo, t_hi]: facts of the first day, else the earliest fact of the next day that has any.

    A lookup stays one row however many days its interval spans: the next day's fact is carried over days, not looked for in each.
    """
    cols = lookups.columns
    right = _facts(facts, fact_key or key, ts, value).withColumn("_d", _bucket(F.col("_ts"), _DAY))
    placed = lookups.withColumn("_k", F.col(key)).withColumn("_d", _bucket(F.col(t_lo), _DAY))
    same = (placed.join(right, ["_k", "_d"]).where((F.col("_ts") >= F.col(t_lo)) & (F.col("_ts") <= F.col(t_hi)))
            .select(*cols, F.struct("_ts", "_v").alias("_c")))
    later = _carried(placed, right, cols).select(*cols, F.when(F.col("_next._ts") <= F.col(t_hi), F.col("_next")).alias("_c"))
    hit = same.unionByName(later).groupBy(*cols).agg(F.min("_c").alias("_hit"))
    return _unpack(hit, cols, value)


def _carried(placed: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Every lookup row (``placed`` adds its ``_k`` and ``_d``) with ``_prev``, the last fact of an earlier day, and ``_next``, the first of a later one.

    The windows run over one row per (key, day), from the facts and the asked days, so they grow with calendar time alone.
    """
    pt = F.struct("_ts", "_v")
    daily = right.groupBy("_k", "_d").agg(F.min(pt).alias("_first"), F.max(pt).alias("_last"))
    days = (daily.unionByName(placed.select("_k", "_d").distinct(), allowMissingColumns=True)
            .groupBy("_k", "_d").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last")))
    up = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("_k").orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    line = days.select("_k", "_d", F.last("_last", ignorenulls=True).over(up).alias("_prev"), F.last("_first", ignorenulls=True).over(down).alias("_next"))
    return attach(placed, line, ["_k", "_d"], "left")


def neighbours(lookups: DataFrame, facts: DataFrame, key: str, t: str, ts: str, value: str) -> DataFrame:
    """Lookup rows with the last fact at or before ``t`` (``prev``) and the first at or after it (``next``).

    Facts of the same day are compared directly; other days are represented by their first and last
    fact, carried to the lookup by windows over days, so a window grows with calendar time and not
    with the number of facts.
    """
    cols = lookups.columns
    pt = F.struct("_ts", "_v")
    right = _facts(facts, key, ts, value).withColumn("_d", _bucket(F.col("_ts"), _DAY))
    placed = lookups.withColumn("_k", F.col(key)).withColumn("_d", _bucket(F.col(t), _DAY))
    same = (placed.join(right, ["_k", "_d"])
            .groupBy(*cols).agg(F.max(F.when(F.col("_ts") <= F.col(t), pt)).alias("prev"),
                                F.min(F.when(F.col("_ts") >= F.col(t), pt)).alias("next")))
    other = _carried(placed, right, cols).select(*cols, F.col("_prev").alias("prev"), F.col("_next").alias("next"))
    return same.unionByName(other).groupBy(*cols).agg(F.max("prev").alias("prev"), F.min("next").alias("next"))


def last_before(lookups: DataFrame, facts: DataFrame, key: str, t: str, ts: str, value: str) -> DataFrame:
    """Last fact strictly before ``t``."""
    cols = lookups.columns
    shifted = lookups.withColumn("_before", F.col(t) - F.expr("interval 1 microsecond"))
    hit = neighbours(shifted, facts, key, "_before", ts, value)
    return hit.select(*cols, F.col("prev._ts").alias(f"{value}_ts"), F.col("prev._v").alias(value))

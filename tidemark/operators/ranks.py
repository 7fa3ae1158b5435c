"""Exact ranks and percentiles of groups that may be very large.

A plain window or ``percentile`` would bring a whole group to one task. Here equal values are first
collapsed to a count and put in order by range partitions, whose splitters Spark samples, so a group of any size is cut at
equal depth whatever its values look like. Every partition numbers its rows as they lie; the few totals of (partition, group)
give the rest. No task holds more than one partition's distinct values at a time, and none gathers a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hot import attach
from tidemark.session import staged

#: distinct values in a range partition, about; more partitions are made where one holds over twice as many
PER_RANGE = 1_000_000


def _same(left: str, right: str, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def ranked_values(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct (groups, value): copies ``n``, rows with a smaller value ``below``, group ``total``.

    NULL groups are ordinary groups; NULL values are left out.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = (df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(n.cast("long").alias("n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _in_ranges(counts, groups, parts)
    most = rows.groupBy("_part").count().agg(F.max("count")).first()[0] or 0
    if most > 2 * PER_RANGE:
        rows = _in_ranges(rows.drop("_part", "_run"), groups, parts * -(-most // PER_RANGE))
    sums = rows.groupBy(*groups, "_part").agg(F.min("_run").alias("_start"), F.sum("n").alias("_bn"))
    by_group = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))
    offsets = (sums.withColumn("_offset", F.coalesce(F.sum("_bn").over(
        by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_start"))
        .withColumn("total", F.sum("_bn").over(by_group)).drop("_bn", "_start"))
    j = rows.alias("c").join(offsets.alias("o"), _same("c", "o", [*groups, "_part"]))
    return j.select(*[F.col(f"c.{c}").alias(c) for c in [*groups, "value", "n"]], (F.col("o._offset") + F.col("c._run")).alias("below"), "o.total")


def _in_ranges(counts: DataFrame, groups: list[str], parts: int) -> DataFrame:
    """``counts`` in order of group and value, written: ``_part`` the range, ``_run`` the sum of ``n`` of the rows before in this range."""
    order = [*groups, "value"]
    placed = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = b.column(b.schema.names.index("n")).to_numpy()
            upto = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - n, pa.int64())], names=[*b.schema.names, "_run"])
            before = int(upto[-1]) if len(upto) else before

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return staged(placed.mapInArrow(run, f"{kinds}, _run bigint"))


def value_at_rank(ranked: DataFrame, groups: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Per group the values at 0-based ranks, each rank an expression of ``total``."""
    aggs = [F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col("value"))).alias(name)
            for name, r in ranks.items()]
    return ranked.groupBy(*groups).agg(F.max("total").alias("total"), *aggs)


def percentiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
                extra: list[Column] | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group, as columns named by ``probs``; ``total`` is the count.

    ``extra`` adds aggregates over the rows (value, n, below, total).
    """
    return percentiles_of(ranked_values(df, groups, value), groups, probs, extra)


def percentiles_of(ranked: DataFrame, groups: list[str], probs: dict[str, float],
                   extra: list[Column] | None = None) -> DataFrame:
    def pos(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(p))

    def pick(r: Column) -> Column:
        return F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col("value").cast("double")))

    aggs = []
    for name, p in probs.items():
        aggs += [pick(F.floor(pos(p))).alias(f"_lo_{name}"), pick(F.ceil(pos(p))).alias(f"_hi_{name}")]
    out = ranked.groupBy(*groups).agg(F.max("total").alias("total"), *aggs, *(extra or []))
    for name, p in probs.items():
        frac = pos(p) - F.floor(pos(p))
        out = out.withColumn(name, F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac) \
            .drop(f"_lo_{name}", f"_hi_{name}")
    return out


def with_ranks(df: DataFrame, groups: list[str], value: str, prefix: str = "", ranked: DataFrame | None = None) -> DataFrame:
    """Add ``avg_rank`` (ties averaged), ``cume`` (share of the group at or below) and ``cell_n`` to each row.

    ``ranked`` are these ranks, if they were made before.
    """
    r = (ranked or ranked_values(df, groups, value)).select(
        *groups, F.col("value").alias("_rv"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"{prefix}avg_rank"),
        ((F.col("below") + F.col("n")) / F.col("total")).alias(f"{prefix}cume"), F.col("total").alias(f"{prefix}cell_n"))
    out = attach(df.withColumn("_rv", F.col(value)), r, [*groups, "_rv"], "left")
    return out.drop("_rv")


def with_place(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Add the 1-based place of every row in descending order of ``value``, NULL last, ties by ``tie``.

    The order is a range sort: its partitions follow each other, so a row's place is its place in the partition plus the
    rows of the partitions before it, whose counts are one small row each.
    """
    rows = df.orderBy(F.desc_nulls_last(value), tie).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    before = (rows.groupBy("_part").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (rows.join(before.select("_part", "_before"), "_part")
            .withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_at", "_in", "_before"))


def moments(value: Column) -> list[Column]:
    """Aggregates over ranked rows (value, n): mean, population deviation, skewness, excess kurtosis.

    Power sums keep the work additive; values are scores of order one.
    """
    x, n = value.cast("double"), F.col("n")
    return [F.sum(n).alias("_n0"), F.sum(n * x).alias("_n1"), F.sum(n * x * x).alias("_n2"),
            F.sum(n * F.pow(x, 3.0)).alias("_n3"), F.sum(n * F.pow(x, 4.0)).alias("_n4")]


def finish_moments(df: DataFrame) -> DataFrame:
    m = F.col("_n1") / F.col("_n0")
    e2, e3, e4 = (F.col(f"_n{i}") / F.col("_n0") for i in (2, 3, 4))
    var = F.greatest(e2 - m * m, F.lit(0.0))
    return (df.withColumn("mean", m).withColumn("std", F.sqrt(var))
            .withColumn("skewness", F.try_divide(e3 - 3 * m * e2 + 2 * F.pow(m, 3.0), F.pow(var, 1.5)))
            .withColumn("kurtosis", F.try_divide(e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * F.pow(m, 4.0), var * var) - 3.0)
            .drop("_n0", "_n1", "_n2", "_n3", "_n4"))

"""Exact distinct counts by bitmaps of dense numbers.

A key column (markets, targets) is numbered once from 1 without holes. A group's keys are then bits: one bitmap of 32,768 numbers in each
(group, bucket), built before the shuffle, and merged by OR over days, partitions or batches without going back to the rows.
It serves groups that hold many keys, and several conditions at once; for very many groups of few keys (wallets) pairs are smaller than bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import with_place


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """(``column``, number) for the distinct values, from 1 without holes; NULL has none."""
    keys = df.where(F.col(column).isNotNull()).select(column).distinct()
    return with_place(keys, column, column, "number").select(column, "number")


def bitmaps(df: DataFrame, groups: list[str], column: str, numbers: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(groups, bucket and one bitmap for each condition): the keys of the rows where it holds. ``groups`` may hold a day, for tables that are kept and merged."""
    n = F.col("number")
    j = df.join(numbers, column, "left")
    return j.groupBy(*groups, F.bitmap_bucket_number(n).alias("bucket")).agg(*[
        F.bitmap_construct_agg(F.bitmap_bit_position(F.when(c, n))).alias(name) for name, c in conditions.items()])


def merge_bitmaps(maps: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Bitmaps of fewer ``groups`` (without the day, say): a key of several merged rows is one bit."""
    return maps.groupBy(*groups, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in names])


def bitmap_counts(maps: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Distinct keys of each group from its bitmaps, one bitmap for a (group, bucket)."""
    return maps.groupBy(*groups).agg(*[F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).alias(n) for n in names])


def distinct_counts(df: DataFrame, groups: list[str], column: str, conditions: dict[str, Column]) -> DataFrame:
    """Distinct values of ``column`` per group where each condition holds; NULLs don't count. A group without any has zeros."""
    maps = bitmaps(df, groups, column, dense_numbers(df, column), conditions)
    return bitmap_counts(maps, groups, list(conditions))

"""Facts stored in partitions (by week, or by a hash of the key) and merged partition by partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import staged
from tidemark.sources.upsert import upsert

WEEK = "week"
BUCKET = "bucket"


def week_of(ts: str = "ts") -> Column:
    """Monday of a row's week."""
    return F.date_trunc("week", F.col(ts)).cast("date")


def bucket_of(key: str, buckets: int = 64) -> Column:
    """Bucket of a key, for tables that have no time."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Stored:
    """A table below ``path`` with one row per ``keys``; ``part`` is computed from key columns alone, so a key stays in its partition.

    Files are written in order of partition, keys and nothing else, by range: a large partition is written by several tasks, and the
    statistics of the files let a scan skip those without the asked keys.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    part: Column
    name: str = WEEK

    def rows(self) -> DataFrame:
        """The whole table with its partition column; filters on that column are never read past."""
        return self.spark.read.parquet(self.path)

    def between(self, low, high, ts: str = "ts") -> DataFrame:
        """Rows of low <= ts < high of a table by week, from the weeks that can hold them."""
        low, high = F.lit(low), F.lit(high)
        weeks = (F.col(self.name) >= F.date_trunc("week", low).cast("date")) & (F.col(self.name) <= high.cast("date"))
        return self.rows().where(weeks & (F.col(ts) >= low) & (F.col(ts) < high))

    def _write(self, df: DataFrame, mode: str) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = [self.name, *self.keys]
        (df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy(self.name).parquet(self.path))

    def create(self, df: DataFrame) -> Stored:
        """Write the first rows; a table that is there already stays an error."""
        self._write(df.withColumn(self.name, self.part), "error")
        return self

    def touched(self, new: DataFrame) -> list:
        """Partitions of some rows: one small value for each, however many rows."""
        return [r[0] for r in new.select(self.part.alias("p")).distinct().collect()]

    def _typed(self, df: DataFrame) -> DataFrame:
        """Rows in the columns and types of the stored table; a value that doesn't fit its type is an error."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.rows().schema])

    def _only(self, parts: list) -> DataFrame:
        there = [p for p in parts if p is not None]
        return self.rows().where(F.col(self.name).isin(there) | (F.col(self.name).isNull() if None in parts else F.lit(False)))

    def merged(self, new: DataFrame, policy: str | dict[str, str] = "overwrite") -> DataFrame:
        """What the touched partitions hold after a merge: only these are read."""
        new = self._typed(new.withColumn(self.name, self.part))
        return self._typed(upsert(self._only(self.touched(new)), new, [self.name, *self.keys], policy))

    def merge(self, new: DataFrame, policy: str | dict[str, str] = "overwrite") -> None:
        """Merge one-row-per-key rows. Partitions without new rows are neither read nor written; ``do_nothing`` only adds files.

        A merge that is run again gives the same table, so a failed one is simply repeated.
        """
        new = staged(new)
        parts = self.touched(new)
        if not parts:
            return
        if policy == "do_nothing":
            old = self._only(parts)
            placed = self._typed(new.withColumn(self.name, self.part))
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (self.name, *self.keys)]
            self._write(placed.alias("n").join(old.select(self.name, *self.keys).alias("o"), same, "left_anti"), "append")
            return
        self._write(staged(self.merged(new, policy)), "overwrite")  # written beside the table first: a partition is replaced from rows that are whole

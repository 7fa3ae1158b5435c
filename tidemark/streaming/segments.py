"""A keyed table as a log of segments with compaction, for streams that overwrite what earlier batches wrote.

Layout below one folder: ``log/b=<batch>`` (reduced rows of a batch), ``done/b=<batch>`` (that its segment is whole),
``base/v=<version>`` (compacted rows) and ``versions/v=<version>`` (the last batch that a base covers). A version is
written after its base and nothing is changed in place, so a reader that has resolved an older version goes on reading it while a compaction runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segments:
    """One row per ``keys``; of several batches that hold a key the last wins. ``schema`` is the table's DDL."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str

    def create(self) -> Segments:
        """An empty table: version 0 over no batch."""
        nothing = self.spark.createDataFrame([], self.schema)
        nothing.write.parquet(f"{self.path}/base/v=0")
        nothing.write.parquet(f"{self.path}/log/b=-1")
        self.spark.range(0).write.parquet(f"{self.path}/done/b=-1")
        self.spark.createDataFrame([(-1,)], "upto bigint").write.parquet(f"{self.path}/versions/v=0")
        return self

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's segment (one row per key). A batch that is run again replaces its own segment."""
        rows.write.mode("overwrite").parquet(f"{self.path}/log/b={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/done/b={batch}")

    def version(self) -> tuple[int, int]:
        """The newest version and the last batch in its base."""
        t = self.spark.read.schema("upto bigint, v bigint").parquet(f"{self.path}/versions")
        return tuple(t.orderBy(F.desc("v")).select("v", "upto").first())

    def batches(self, upto: int) -> list[int]:
        """Whole segments after a batch: as many as were written since a compaction."""
        t = self.spark.read.schema("id bigint, b bigint").parquet(f"{self.path}/done")
        return sorted(r.b for r in t.where(F.col("b") > upto).select("b").distinct().collect())

    def _merged(self, version: int, batches: list[int]) -> DataFrame:
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/base/v={version}").withColumn("b", F.lit(-1).cast("bigint"))
        log = self.spark.read.schema(f"{self.schema}, b bigint").parquet(f"{self.path}/log").where(F.col("b").isin(batches) if batches else F.lit(False))
        values = [c for c in base.columns if c not in (*self.keys, "b")]
        last = base.unionByName(log).groupBy(*self.keys).agg(F.max_by(F.struct(*values), "b").alias("r"))
        return last.select(*self.keys, *[f"r.{c}" for c in values])

    def read(self, at: tuple[int, int] | None = None) -> DataFrame:
        """The table now, or as a reader saw it that resolved the version ``at``: its base and every whole segment after that."""
        version, upto = at or self.version()
        return self._merged(version, self.batches(upto))

    def compact(self) -> int:
        """Fold all whole segments into a new base; returns its version. Without new segments nothing is written."""
        version, upto = self.version()
        batches = self.batches(upto)
        if not batches:
            return version
        self._merged(version, batches).write.mode("overwrite").parquet(f"{self.path}/base/v={version + 1}")  # left by a failed run, it is in no version
        self.spark.createDataFrame([(batches[-1],)], "upto bigint").write.parquet(f"{self.path}/versions/v={version + 1}")
        return version + 1

    def compacted(self) -> DataFrame:
        """The newest base alone."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/base/v={self.version()[0]}")

    def superseded(self, keep: int = 2) -> list[str]:
        """Folders that no reader of the last ``keep`` versions needs; whoever owns the storage may delete them."""
        versions = sorted((r.v, r.upto) for r in self.spark.read.schema("upto bigint, v bigint").parquet(f"{self.path}/versions").collect())
        oldest = versions[-keep:][0]
        return [f"{self.path}/base/v={v}" for v, _ in versions if v < oldest[0]] + [f"{self.path}/log/b={b}" for b in self.batches(-1) if b <= oldest[1]]

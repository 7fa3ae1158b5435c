"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_key(c: Column) -> Column:
    """A 64-bit digest that stands for a text beside its document id."""
    return F.xxhash64(F.coalesce(c, F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int):
    """A batch in runs of rows whose texts have ``most`` bytes together, or one row."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    total, start = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield batch.slice(start, k - start)
            total, start = 0, k
        total += int(size)
    yield batch.slice(start)


def free(name: str, *taken) -> str:
    """``name``, lengthened until none of the given columns or frames has it."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in used:
        name += "_"
    return name

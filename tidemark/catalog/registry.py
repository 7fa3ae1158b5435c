"""Query registry: a Spark callable, its column contract, and its SQL twin.

The column contract (``"market_id n:l vwap:d"``) is applied to both sides, so names and types agree:
no letter = string, ``l`` bigint, ``d`` double shown with 6 places, ``b`` boolean, ``t`` timestamp,
``D`` date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.adapters import Views, with_views

# exact ties at the 7th place are decimal on one side and binary on the other; a fixed nudge on both
# sides makes them round the same way
NUDGE = "1e-9"

_SPARK = {"s": "string", "l": "bigint", "d": "double", "b": "boolean", "t": "timestamp", "D": "date"}
_DUCK = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN", "t": "TIMESTAMP", "D": "DATE"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.split(":")[0], c.split(":")[1] if ":" in c else "s") for c in spec.split()]


@dataclass(frozen=True)
class Query:
    key: str
    cols: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Views(spark, sf_dir))
        out = []
        for name, kind in _columns(self.cols):
            c = F.col(name).cast(_SPARK[kind])
            out.append((F.round(c + F.lit(float(NUDGE)), 6) if kind == "d" else c).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in _columns(self.cols):
            c = f"cast({name} as {_DUCK[kind]})"
            out.append(f"{f'round({c} + {NUDGE}, 6)' if kind == 'd' else c} as {name}")
        body = with_views(self.sql)
        return f"select {', '.join(out)} from (\n{body}\n) q"


REGISTRY: dict[str, Query] = {}


def query(key: str, cols: str, sql: str | None = None):
    """Register the decorated ``fn(views) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, cols, fn, sql)
        return fn
    return deco

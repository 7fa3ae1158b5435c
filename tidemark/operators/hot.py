"""Joins of a large fact table with a per-key dimension when one key may hold most of the facts."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("inner", "left", "left_semi", "left_anti")
#: facts of one key that a task may hold; a key with over twice as many is heavy and gets a salt for each so many
ROWS_CONF = "spark.tidemark.rowsPerSalt"
ROWS = 2_000_000
#: keys that the sketch can name; any key with more than the ``TRACKED``-th part of the facts is among them
TOP, TRACKED = 64, 10_000

_known: OrderedDict[tuple, dict[int, int]] = OrderedDict()


def _digest(on: list[str]) -> Column:
    """A number for a key; NULL in one column is not NULL in another."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in on], *[F.col(f"`{c}`").isNull() for c in on])


def heavy_keys(fact: DataFrame, on: list[str]) -> dict[int, int]:
    """Salts of the heavy keys, by key digest, from a mergeable frequent-items sketch over the key columns alone.

    At most ``TOP`` small numbers reach the driver. The answer is kept for the plan of the facts, so jobs over the same table ask once; a
    table that has grown since only gets fewer salts than it could have.
    """
    spark = fact.sparkSession
    rows = int(spark.conf.get(ROWS_CONF, str(ROWS)))
    keys = fact.select(*on)
    known = (spark.sparkContext.applicationId, keys.semanticHash(), tuple(on), rows)
    if known not in _known:
        got = keys.select(_digest(on).alias("d")).agg(F.expr(f"approx_top_k(d, {TOP}, {TRACKED})").alias("top")).first()["top"] or []
        _known[known] = {r["item"]: -(-r["count"] // rows) for r in got if r["count"] > 2 * rows}
        while len(_known) > 1000:
            _known.popitem(last=False)
    return _known[known]


def _salts(heavy: dict[int, int], on: list[str]) -> Column:
    """Number of salts of a row's key: 1 unless it is heavy."""
    d = _digest(on)
    arms = F.lit(1)
    for item, n in heavy.items():
        arms = F.when(d == F.lit(item), n).otherwise(arms)
    return arms


def join_hot(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
             spread: list[str] | None = None) -> DataFrame:
    """Join so that one hot key is spread over several tasks.

    Without heavy keys the join is a plain one. Otherwise a fact of a heavy key gets a salt from a hash of its own ``spread`` columns
    (its identity), and only the dimension rows of heavy keys are repeated, once per salt, as many as their count asks for. The salt is a
    function of the row, so a re-run task sends every row to the same place. Only join kinds without unmatched dimension rows
    are taken: those would come out once per salt.
    """
    if how not in KINDS:
        raise ValueError(f"join_hot and attach take {', '.join(KINDS)}, not {how}")
    heavy = heavy_keys(fact, on)
    if not heavy:
        return fact.join(dim, on, how)
    cols = spread or [c for c in fact.columns if c not in on]
    f = fact.withColumn("_salt", F.pmod(F.xxhash64(*cols), _salts(heavy, on)).cast("int"))
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(heavy, on) - 1)))
    return f.join(d, [*on, "_salt"], how).drop("_salt")


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add the columns of a one-row-per-key table; NULL keys match each other.

    ``small`` has the key columns and the new columns only. It has no more rows than ``df`` has keys, so Spark's adaptive join broadcasts it or
    splits a skewed side as it finds them.
    """
    if how not in KINDS:
        raise ValueError(f"join_hot and attach take {', '.join(KINDS)}, not {how}")
    rest = [c for c in small.columns if c not in keys]
    s = small.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *rest)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return df.join(s, cond, how).drop(*[f"_s_{k}" for k in keys])

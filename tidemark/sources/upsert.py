"""Keyed merges without a MERGE statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order; copies are dropped before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], policy: str | dict[str, str] = "overwrite") -> DataFrame:
    """Merge one-row-per-key tables of the same columns.

    Policies, for all columns or per column: ``overwrite`` (new row wins, also with NULL),
    ``coalesce`` (new value unless NULL), ``keep`` (old row wins), ``least`` and ``greatest``.
    ``"do_nothing"`` keeps old rows whole and adds only unseen keys. NULL keys match each other.
    """
    if policy == "do_nothing":
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        return existing.unionByName(new.alias("n").join(existing.select(*keys).alias("o"), same, "left_anti").select(*existing.columns))
    o, n = existing.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = F.col("o._o") & F.col("n._n")
    out = []
    for c in existing.columns:
        old, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            out.append(F.coalesce(now, old).alias(c))
            continue
        p = policy if isinstance(policy, str) else policy.get(c, "keep")
        merged = {"overwrite": now, "coalesce": F.coalesce(now, old), "keep": old,
                  "least": F.least(now, old), "greatest": F.greatest(now, old)}[p]
        out.append(F.when(both, merged).when(F.col("n._n"), now).otherwise(old).alias(c))
    return o.join(n, cond, "full_outer").select(*out)

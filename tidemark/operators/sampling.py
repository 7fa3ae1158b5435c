"""Seeded samples by stratum. A row's place depends on a digest of seed and id only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import SEED

# ---- fixed values: benchmark quotas per topic, and where a shortfall is filled from ----
SIBLINGS = {"politics": "geopolitics", "geopolitics": "politics", "crypto": "economics", "economics": "crypto",
            "sports": "entertainment", "entertainment": "sports"}
TOPIC_QUOTAS = {"crypto": 8, "politics": 8, "sports": 8, "economics": 8, "geopolitics": 9, "entertainment": 9}


def seeded_order(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _lookup(column: str, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def first_in_order(df: DataFrame, stratum: str, key: str, most: int, seed: int = SEED) -> DataFrame:
    """The first ``most`` rows per stratum with their place ``rn``; cut before the shuffle as well as after it."""
    w = Window.partitionBy(stratum).orderBy(seeded_order(key, seed), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def stratified_sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int = SEED) -> DataFrame:
    """Fixed number of rows per stratum."""
    return first_in_order(df, stratum, key, max(quotas.values()), seed).where(F.col("rn") <= _lookup(stratum, quotas))


def proportional_sample(df: DataFrame, pilot: DataFrame, stratum: str, key: str, target: int, seed: int = SEED) -> DataFrame:
    """Rows per stratum in proportion to a pilot, at least one each."""
    sizes = pilot.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_q", F.col("_n") / pilot.agg(F.count("*")).scalar())
    top = first_in_order(df, stratum, key, target, seed)
    quota = F.greatest(F.lit(1), F.bround(F.coalesce("_q", F.lit(0.0)) * target).cast("int"))
    return top.join(sizes.select("_s", "_q"), F.col(stratum) == F.col("_s"), "left").where(F.col("rn") <= quota).drop("_s", "_q")


def quota_sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int] = TOPIC_QUOTAS,
                 siblings: dict[str, str] = SIBLINGS, seed: int = SEED) -> DataFrame:
    """Quota per stratum; a shortfall is filled from the sibling's rows that are beyond its own quota.

    A row is drawn at most once: own quotas are served first, and each stratum has one sibling.
    """
    most = max(q + quotas.get(siblings[s], 0) for s, q in quotas.items())
    top = first_in_order(df.where(F.col(stratum).isin(list(quotas))), stratum, key, most, seed)
    own = top.where(F.col("rn") <= _lookup(stratum, quotas)).withColumn("slot", F.col(stratum))
    have = own.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    need = (df.sparkSession.createDataFrame([(s, q, siblings[s]) for s, q in quotas.items()], "_s string, _q int, _sib string")
            .join(have, "_s", "left").select(F.col("_s").alias("_slot"), "_sib", (F.col("_q") - F.coalesce("_n", F.lit(0))).alias("_short"))
            .where("_short > 0"))
    spare = top.withColumn("_extra", F.col("rn") - _lookup(stratum, quotas)).where("_extra > 0")
    fill = spare.join(need, F.col(stratum) == F.col("_sib")).where("_extra <= _short").withColumn("slot", F.col("_slot"))
    return own.unionByName(fill.select(*own.columns))

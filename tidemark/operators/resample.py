"""Bootstrap intervals that do not gather a sample in one place.

Weighted means use Poisson weights: each row contributes to each replicate on its own, and a task keeps the
sums of a group for all replicates in one array. Percentiles use order statistics: the m-th
smallest of n resampled values is the value whose rank is ceil(n * U), U ~ Beta(m, n - m + 1), so a
replicate needs two ranks and not a resample. Proportions use binomial draws. All draws are a
function of seed, group and replicate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

try:  # Python's own digest starts sooner than OpenSSL's, which counts for short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BOOTSTRAP_B, CELL_BOOTSTRAP_B, MIN_VALID_SHARE, SEED
from tidemark.operators.hot import attach
from tidemark.operators.ranks import ranked_values
from tidemark.session import staged

# beyond 17 the probability is below the step of a double uniform number
_CUTS = list(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]))


#: rows of a group that are resampled in one task, rows whose draws are held at once, and groups whose sums are
ROWS, CHUNK, GROUPS = 20_000, 2_000, 1_000
#: proportions whose draws are held at once
DRAWN = 256


def poisson_counts(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniform numbers."""
    out = np.zeros(u.shape, np.uint8)
    for cut in _CUTS:  # few numbers pass the higher cuts
        over = u >= cut
        if not over.any():
            break
        out += over
    return out.astype(np.float64)


def uniforms(ids: list | np.ndarray, replicates: int, seed: int, portable: bool = False) -> np.ndarray:
    """Uniform numbers, a row for each id and a column for each replicate; ``portable`` ones are digests that other engines share.

    A digest of seed, number of the four and id gives four replicates their numbers.
    """
    if portable:
        fours = -(-replicates // 4)
        heads = [f"{seed}|{q}|".encode() for q in range(fours)]
        whole = b"".join(md5(h + i).digest() for i in (str(i).encode() for i in ids) for h in heads)
        return (np.frombuffer(whole, ">u4").reshape(len(ids), 4 * fours)[:, :replicates]) / 4294967296.0
    with np.errstate(over="ignore"):
        x = np.asarray(ids, np.int64).view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0


def _identity(groups: list[str]) -> Column:
    """A number for a group; NULL in one column is not NULL in another."""
    return F.xxhash64(F.lit(0), *[F.col(f"`{g}`") for g in groups], *[F.col(f"`{g}`").isNull() for g in groups])


def _sums(replicates: int, seed: int, portable: bool, n_groups: int):
    """Per run of rows: weighted sums of each group in every replicate, as two arrays beside the group's columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # group -> its columns, sums of weighted values, sums of weights

        def out():
            columns = [pa.concat_arrays([h[0].column(k) for h in held.values()]) for k in range(n_groups)]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * replicates, pa.int32()), pa.array(np.concatenate([h[j] for h in held.values()]))) for j in (1, 2)]
            return pa.RecordBatch.from_arrays([*columns, *arrays], names=[f"g{k}" for k in range(n_groups)] + ["s", "n"])

        for b in batches:
            ids, x, w, g = (b.column(n_groups + k) for k in range(4))
            x, w, g = (c.to_numpy(zero_copy_only=False) for c in (x, w, g))
            for start in range(0, b.num_rows, CHUNK):
                stop = min(start + CHUNK, b.num_rows)
                part = ids.slice(start, stop - start)
                k = poisson_counts(uniforms(part.to_pylist() if portable else part.to_numpy(), replicates, seed, portable))
                for key in np.unique(g[start:stop]).tolist():
                    at = np.flatnonzero(g[start:stop] == key)
                    weight = w[start:stop][at]
                    s, n = (weight * x[start:stop][at]) @ k[at], weight @ k[at]
                    if key in held:
                        held[key][1] += s
                        held[key][2] += n
                    else:
                        held[key] = [b.slice(start + int(at[0]), 1), s, n]
                if len(held) >= GROUPS:
                    yield out()
                    held.clear()
        if held:
            yield out()
    return run


def replicate_means(df: DataFrame, groups: list[str], row_id: str, value: str, weight: str | None = None,
                    replicates: int = BOOTSTRAP_B, seed: int = SEED, portable: bool = False) -> DataFrame:
    """(groups, b, mean): weighted mean of every replicate; no mean where all its weights are zero.

    Rows are never repeated: a task draws a row's counts for all replicates and adds them to two arrays of its group, and only
    such arrays are shuffled, one pair for about ``ROWS`` rows of a group. NULL groups are groups; NULL values are left out.
    """
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = F.col(value).cast("double")
    names = [f"g{k}" for k in range(len(groups))]
    row = F.col(row_id).cast("string") if portable else F.xxhash64(row_id)
    base = df.where(x.isNotNull() & w0.isNotNull()).select(*[F.col(g).alias(n) for g, n in zip(groups, names)], row.alias("_id"), x.alias("_x"), w0.alias("_w"))
    base = base.withColumn("_g", _identity(names))
    sizes = base.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("_parts"))
    spread = attach(base, sizes, ["_g"]).withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    placed = spread.repartition("_g", "_p").sortWithinPartitions("_g").select(*names, "_id", "_x", "_w", "_g")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema[:len(names)])
    kinds = f"{kinds}, " if kinds else ""
    sums = placed.mapInArrow(_sums(replicates, seed, portable, len(names)), f"{kinds}s array<double>, n array<double>")
    long = sums.select(*names, F.posexplode(F.arrays_zip("s", "n")).alias("b", "r"))
    out = long.groupBy(*names, (F.col("b") + 1).alias("b")).agg(F.sum("r.s").alias("_s"), F.sum("r.n").alias("_n")).where("_n > 0" if weight is None else "true")
    return out.select(*[F.col(n).alias(g) for g, n in zip(groups, names)], "b", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("mean"))


def interval(reps: DataFrame, groups: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval; a group holds one row per replicate, so it is small by construction."""
    return reps.groupBy(*groups).agg(F.count(value).alias("n_valid"), F.percentile(value, low).alias("ci_low"),
                                     F.percentile(value, high).alias("ci_high"))


def _rng(seed: int, *parts) -> np.random.Generator:
    """Generator seeded by a digest of all parts, each with its length."""
    whole = b"".join(len(t).to_bytes(8, "big") + t for t in (str(p).encode() for p in (seed, *parts)))
    return np.random.default_rng(int.from_bytes(hashlib.sha256(whole).digest(), "big"))


def _percentile_ranks(n: int, p: float, size: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """0-based ranks, in the original sample, of the two order statistics around percentile p."""
    pos = (n - 1) * p
    lo, frac = int(math.floor(pos)), pos - math.floor(pos)
    m = lo + 1
    u = rng.beta(m, n - m + 1, size)
    r_lo = np.minimum(np.ceil(n * u).astype(np.int64), n) - 1
    if frac == 0 or m >= n:
        return r_lo, r_lo, frac
    # the next order statistic: the smallest of the n - m remaining uniforms above u
    nxt = u + (1 - u) * rng.beta(1, n - m, size)
    return r_lo, np.minimum(np.ceil(n * nxt).astype(np.int64), n) - 1, frac


def percentile_replicates(df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
                          replicates: int = CELL_BOOTSTRAP_B, seed: int = SEED) -> DataFrame:
    """(groups, stat, b, value): bootstrap replicates of percentiles."""
    # as JSON, so that texts with separators and NULLs stay apart; written once, as sizes and both ranks read it
    ranked = staged(ranked_values(df, groups, value).withColumn("_g", F.to_json(F.struct(*groups)) if groups else F.lit("all")))
    sizes = ranked.groupBy("_g", *groups).agg(F.max("total").alias("total"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, n in zip(pdf["_g"], pdf["total"]):
                for stat, p in probs.items():
                    lo, hi, frac = _percentile_ranks(int(n), p, replicates, _rng(seed, g, stat))
                    yield pd.DataFrame({"_g": g, "stat": stat, "b": np.arange(1, replicates + 1), "lo": lo, "hi": hi, "frac": frac})

    asked = staged(sizes.select("_g", "total").mapInPandas(draw, "_g string, stat string, b int, lo bigint, hi bigint, frac double"))
    found = values_at_ranks(ranked, asked.select("_g", F.explode(F.array("lo", "hi")).alias("rank")).distinct())
    lo, hi = found.withColumnsRenamed({"rank": "lo", "value": "_vlo"}), found.withColumnsRenamed({"rank": "hi", "value": "_vhi"})
    j = asked.join(lo, ["_g", "lo"]).join(hi, ["_g", "hi"])
    return (j.join(sizes, "_g").select(*groups, "stat", "b", (
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("frac")).alias("value")))


def values_at_ranks(ranked: DataFrame, asked: DataFrame, block: int = 100_000) -> DataFrame:
    """(_g, rank, value) for 0-based ranks.

    Ranks are cut into blocks. Inside a block the last value starting at or before the rank is taken;
    a value whose copies run over several blocks is entered at the start of each of them.
    """
    cuts = F.sequence((F.col("below") / block).cast("bigint"), ((F.col("below") + F.col("n") - 1) / block).cast("bigint"))
    vals = ranked.select("_g", F.col("value").cast("double").alias("value"), "below", F.explode(cuts).alias("_blk")) \
        .select("_g", "_blk", F.greatest(F.col("below"), F.col("_blk") * block).alias("pos"), "value",
                F.lit(None).cast("bigint").alias("rank"))
    ask = asked.select("_g", (F.col("rank") / block).cast("bigint").alias("_blk"), F.col("rank").alias("pos"),
                       F.lit(None).cast("double").alias("value"), "rank")
    w = (Window.partitionBy("_g", "_blk").orderBy("pos", F.col("rank").isNotNull())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (vals.unionByName(ask).withColumn("value", F.last("value", ignorenulls=True).over(w))
            .where("rank is not null").select("_g", "rank", "value"))


def proportion_interval(n: Column, k: Column, key: Column, replicates: int = CELL_BOOTSTRAP_B, seed: int = SEED,
                        low: float = 2.5, high: float = 97.5) -> Column:
    """Bootstrap interval of a proportion k / n as a struct (ci_low, ci_high)."""
    @F.pandas_udf("struct<ci_low: double, ci_high: double>")
    def ci(ns: pd.Series, ks: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = np.full((len(ns), 2), np.nan)
        draws, rows = np.empty((DRAWN, replicates)), []

        def close() -> None:
            out[rows] = np.percentile(draws[:len(rows)], [low, high], axis=1).T
            rows.clear()

        for i, (a, b, key_) in enumerate(zip(ns, ks, keys)):
            if pd.isna(a) or a <= 0 or pd.isna(b):
                continue
            draws[len(rows)] = _rng(seed, key_).binomial(int(a), min(1.0, b / a), replicates) / a
            rows.append(i)
            if len(rows) == DRAWN:
                close()
        if rows:
            close()
        return pd.DataFrame(out, columns=["ci_low", "ci_high"])

    return ci(n.cast("double"), k.cast("double"), key)


def score_interval(trades: DataFrame, refs: DataFrame, replicates: int = BOOTSTRAP_B, seed: int = SEED,
                   min_trades: int = 50, epsilon: float = 0.05, yes_outcome_index: int = 1, portable: bool = False) -> DataFrame:
    """Interval of a deadline score from resampled YES trades between opening and event.

    refs: market_id, t_open, t_event, p_open, p_resolve. NULL below ``min_trades``, for a price close
    to the outcome, or when fewer than nine tenths of the replicates are defined.
    """
    from tidemark.operators.features import trades_in_window
    t = trades_in_window(trades.where(F.col("outcome_index") == yes_outcome_index)
                         .select("market_id", "ts", "tx_hash", "log_index", "price", "notional_usdc"),
                         refs.select("market_id", "t_open", "t_event"), "t_open", "t_event")
    t = t.withColumn("_row", F.concat_ws(":", "tx_hash", F.col("log_index").cast("string")) if portable else F.xxhash64("tx_hash", "log_index"))
    n = t.groupBy("market_id").agg(F.count("*").alias("n_trades"))
    reps = replicate_means(t, ["market_id"], "_row", "price", "notional_usdc", replicates, seed, portable)
    base = refs.select("market_id", F.col("p_open").cast("double").alias("_po"), F.col("p_resolve").cast("double").alias("_pr"))
    scored = reps.join(base, "market_id").withColumn("score", F.try_divide(F.col("mean") - F.col("_po"), F.col("_pr") - F.col("_po")))
    ci = interval(scored, ["market_id"], "score")
    j = base.join(n, "market_id", "left").join(ci, "market_id", "left")
    ok = (F.col("n_trades") >= min_trades) & (F.abs(F.col("_pr") - F.col("_po")) >= epsilon) \
        & (F.col("n_valid") >= replicates * MIN_VALID_SHARE)
    return j.select("market_id", "n_trades", F.when(ok, F.round("ci_low", 6)).alias("ci_low"),
                    F.when(ok, F.round("ci_high", 6)).alias("ci_high"))

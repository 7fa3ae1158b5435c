"""Exact ranks, fits, tests and intervals against NumPy and published values."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.constants import BOOTSTRAP_B, SEED
from tidemark.operators import fits
from tidemark.operators import ranks as rk
from tidemark.operators import resample as rs
from tidemark.operators import sampling as sa
from tidemark.plans import population as pop


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1, 3000).round(3), np.full(1500, 0.25), rng.exponential(50, 500).round(2), [-1e6, 1e6, 0.0]])
    rows = [("hot" if i % 3 else None if i % 2 else "b", float(v)) for i, v in enumerate(vals)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6)


def test_percentiles_match_numpy(skewed):
    rows, df = skewed
    probs = {f"p{p}": p / 100 for p in (1, 25, 50, 75, 99)}
    got = {r["g"]: r for r in rk.percentiles(df, ["g"], "x", probs).collect()}
    for g in ("hot", "b", None):
        v = np.array([x for k, x in rows if k == g])
        assert got[g]["total"] == len(v)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(v, p * 100), rel=1e-12, abs=1e-12)


def test_ranks_and_cume_match_brute_force(skewed):
    rows, df = skewed
    got = rk.with_ranks(df, ["g"], "x").where("g = 'hot'").select("x", "avg_rank", "cume").distinct().collect()
    v = np.array([x for k, x in rows if k == "hot"])
    for r in got[:200]:
        below, same = (v < r["x"]).sum(), (v == r["x"]).sum()
        assert r["avg_rank"] == below + (same + 1) / 2
        assert r["cume"] == pytest.approx((below + same) / len(v))


def test_moments(spark):
    v = np.array([0.1, 0.4, 0.4, -0.3, 0.9, 0.2])
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, x double")
    r = rk.finish_moments(rk.percentiles(df, ["g"], "x", {"m": 0.5}, rk.moments(F.col("value")))).collect()[0]
    d = v - v.mean()
    assert r["std"] == pytest.approx(v.std())
    assert r["skewness"] == pytest.approx((d ** 3).mean() / v.std() ** 3)
    assert r["kurtosis"] == pytest.approx((d ** 4).mean() / v.var() ** 2 - 3)


def _delays(spark, tau, cell=("regulatory_decision", None, "post_2024")):
    return spark.createDataFrame([(*cell, f"m{i}", float(t)) for i, t in enumerate(tau)],
                                 "category string, subcategory string, period string, market_id string, tau_days double")


def test_exponential_matches_published_cell(spark):
    """22 delays of mean 1/0.048173 days: half-life 14.389 days and AIC 179.45."""
    tau = np.full(22, 1 / 0.048173)
    r = fits.hazard_exponential(_delays(spark, tau)).collect()[0]
    assert round(r["half_life_days"], 3) == 14.389
    f = fits.functional_forms(_delays(spark, tau * np.linspace(0.5, 1.5, 22)), weibull=False).where("distribution = 'exponential'").collect()[0]
    assert round(f["aic"], 2) == 179.45


def _weibull_mle(x):
    lo, hi = 0.01, 100.0
    lx = np.log(x)
    for _ in range(200):
        k = (lo + hi) / 2
        p = np.exp(k * (lx - lx.max()))
        if (p * lx).sum() / p.sum() - 1 / k - lx.mean() > 0:
            hi = k
        else:
            lo = k
    return k, np.exp(np.log(np.mean(x ** k)) / k)


def test_weibull_against_bisection(spark):
    rng = np.random.default_rng(1)
    a, b = rng.weibull(0.7, 400) * 10 + 1e-3, rng.weibull(2.5, 300) * 40 + 1e-3
    df = _delays(spark, a).unionByName(_delays(spark, b, ("other", "s", "pre_2024")))
    got = {r["category"]: r for r in fits.functional_forms(df).where("distribution = 'weibull'").collect()}
    for key, x in (("regulatory_decision", a), ("other", b)):
        k, s = _weibull_mle(x)
        assert got[key]["shape"] == pytest.approx(k, rel=1e-5)
        assert got[key]["scale"] == pytest.approx(s, rel=1e-5)
        ll = (np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k).sum()
        assert got[key]["log_lik"] == pytest.approx(ll, rel=1e-8)


def test_winner_and_simpler_preference(spark):
    rng = np.random.default_rng(2)
    forms = fits.functional_forms(_delays(spark, rng.exponential(20, 200) + 1e-3))
    aic = {r["distribution"]: r["aic"] for r in forms.collect()}
    assert fits.best_form(forms).collect()[0]["winner"] == min(aic, key=aic.get)
    assert fits.best_form(forms, prefer_simpler_within=1e9).collect()[0]["winner"] == "exponential"


def test_ks_distance(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.exponential(20, 60))
    df = _delays(spark, x)
    got = {r["distribution"]: r for r in fits.ks_statistic(df, fits.functional_forms(df)).collect()}
    n, i = len(x), np.arange(1, 61)
    f = 1 - np.exp(-x / x.mean())
    assert got["exponential"]["ks"] == pytest.approx(max((i / n - f).max(), (f - (i - 1) / n).max()))
    z = (np.log(x) - np.log(x).mean()) / np.log(x).std()
    f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    assert got["lognormal"]["ks"] == pytest.approx(max((i / n - f).max(), (f - (i - 1) / n).max()))


def test_ks_bootstrap_separates_right_from_wrong(spark):
    rng = np.random.default_rng(4)
    good, bad = _delays(spark, rng.exponential(20, 120)), _delays(spark, rng.uniform(50, 60, 120), ("bad", "s", "p"))
    df = good.unionByName(bad)
    forms = fits.functional_forms(df, weibull=False).where("distribution = 'exponential'")
    got = {r["category"]: r["ks_pvalue_bootstrap"] for r in fits.ks_parametric_bootstrap(fits.ks_statistic(df, forms), replicates=199).collect()}
    assert got["bad"] == 0.005 and got["regulatory_decision"] > 0.02


def test_simulated_distance_does_not_depend_on_chunks():
    for dist in fits.DISTS:
        one = fits._distance(dist, 500, (1, "g", dist, 3), 1_000_000)
        cut = fits._distance(dist, 500, (1, "g", dist, 3), 501)
        assert one == pytest.approx(cut, rel=1e-9)
        many = fits._distance(dist, 500, (1, "g", dist, 3), 64)
        assert 0 < many < 0.2


def test_mann_whitney(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 80).round(1), rng.normal(0.4, 1, 120).round(1)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
    r = fits.mann_whitney(df, "g", "x", "a", "b").collect()[0]
    u = sum((a[:, None] > b[None, :]).sum(axis=1)) + 0.5 * (a[:, None] == b[None, :]).sum()
    assert r["u"] == pytest.approx(u)
    both = np.concatenate([a, b])
    _, t = np.unique(both, return_counts=True)
    n = 200
    sd = math.sqrt(80 * 120 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    assert r["p"] == pytest.approx(math.erfc((abs(u - 4800) - 0.5) / sd / math.sqrt(2)))


def test_binomial_tail():
    for n, k, p in ((22, 5, 0.1), (1000, 130, 0.1), (7, 0, 0.05), (7, 7, 0.05), (50, 1, 0.01)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert fits.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_median_replicates_follow_the_resampling_distribution(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 60).round(3)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    reps = rs.percentile_replicates(df, ["g"], "x", {"median": 0.5}, replicates=3000)
    r = rs.interval(reps, ["g"], "value").collect()[0]
    direct = np.median(rng.choice(x, (20000, 60)), axis=1)
    assert r["n_valid"] == 3000
    assert abs(r["ci_low"] - np.percentile(direct, 2.5)) < 0.08 and abs(r["ci_high"] - np.percentile(direct, 97.5)) < 0.08
    mean = reps.agg(F.avg("value")).collect()[0][0]
    assert abs(mean - direct.mean()) < 0.02


def test_values_at_ranks_across_blocks(spark):
    x = [1.0] * 50 + [2.0] * 7 + [3.0] * 43
    ranked = rk.ranked_values(spark.createDataFrame([("a", v) for v in x], "g string, x double"), ["g"], "x").withColumn("_g", F.lit("a"))
    asked = spark.createDataFrame([("a", r) for r in range(100)], "_g string, rank bigint")
    got = {r["rank"]: r["value"] for r in rs.values_at_ranks(ranked, asked, block=8).collect()}
    assert [got[r] for r in range(100)] == x


def test_mean_replicates_cover_and_repeat(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([("a", f"m{i}", float(v)) for i, v in enumerate(x)], "g string, id string, x double")
    reps = rs.replicate_means(df, ["g"], "id", "x", replicates=400)
    r = rs.interval(reps, ["g"], "mean").collect()[0]
    half = 1.96 * x.std() / 20
    assert abs(r["ci_low"] - (x.mean() - half)) < 0.06 and abs(r["ci_high"] - (x.mean() + half)) < 0.06
    again = rs.interval(rs.replicate_means(df.repartition(7), ["g"], "id", "x", replicates=400), ["g"], "mean").collect()[0]
    assert again["ci_low"] == pytest.approx(r["ci_low"], abs=1e-12)


def test_anchor_rules(spark):
    rows = [("a", 0.5, 0.6, None, None, None), ("b", 0.5, -0.1, None, None, None), ("c", 0.1, 0.5, None, None, None), ("d", 0.5, None, None, None, None)]
    df = spark.createDataFrame(rows, "market_id string, ils_dl double, ils_dl_30min double, ils_dl_2h double, ils_dl_6h double, ils_dl_24h double") \
        .withColumn("in_scope", F.lit(True))
    got = {r["market_id"]: r["anchor_failure_reason"] for r in pop.anchor_flags(df).collect()}
    assert got == {"a": "", "b": "sign_flip", "c": "spread_0.40", "d": ""}


def test_quota_sample_draws_each_row_once(spark):
    rows = [("politics", f"p{i}") for i in range(3)] + [("geopolitics", f"g{i}") for i in range(30)] + [("sports", f"s{i}") for i in range(12)]
    got = sa.quota_sample(spark.createDataFrame(rows, "topic string, id string"), "topic", "id").collect()
    by = {}
    for r in got:
        by.setdefault(r["slot"], []).append(r["topic"])
    assert len(got) == len({r["id"] for r in got})
    assert sorted(by["politics"]) == ["geopolitics"] * 5 + ["politics"] * 3
    assert len(by["geopolitics"]) == 9 and by["sports"] == ["sports"] * 8 and by["entertainment"] == ["sports"] * 4


def test_places_follow_the_whole_order(spark):
    from tidemark.operators.ranks import with_place
    df = spark.range(5000).select(F.format_string("m%05d", "id").alias("m"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 1001).cast("double")).alias("x")).repartition(9)
    got = {r["m"]: r["rank"] for r in with_place(df, "x", "m", "rank").collect()}
    rows = sorted(((r["x"] is None, -(r["x"] or 0), r["m"]) for r in df.collect()))
    assert got == {m: k + 1 for k, (_, _, m) in enumerate(rows)}
    assert with_place(df.limit(0), "x", "m", "rank").count() == 0


def test_error_function(spark):
    xs = [k / 97 for k in range(-700, 2520)] + [0.0, 1e-12, 1.0, 6.28, 6.29, 27.5, 40.0, -30.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    for x, e in df.select("x", fits.erfc(F.col("x"))).collect():
        assert e is None if x is None else e == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)


def test_population_intervals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(m, f"0x{m}{i:03d}", i % 3, t0 + dt.timedelta(minutes=int(i)), float(rng.uniform(0.2, 0.8)), float(rng.uniform(1, 90)), 1 if i % 10 else 0)
            for m, n in (("a", 90), ("b", 40), ("c", 90)) for i in range(n)]
    trades = spark.createDataFrame(rows, "market_id string, tx_hash string, log_index int, ts timestamp, price double, notional_usdc double, outcome_index int")
    late = t0 + dt.timedelta(minutes=80)  # the event takes part, later trades don't
    people = spark.createDataFrame([("a", True, t0, late, 0.3, 1, ""), ("b", True, t0, late, 0.3, 1, ""), ("c", False, t0, late, 0.3, 1, "edge_effect")],
                                   "market_id string, in_scope boolean, t_open timestamp, t_event timestamp, p_open double, p_resolve int, exclusion_reason string")
    got = {r["market_id"]: r for r in pop.with_intervals(people, trades, portable=True).collect()}
    mine = [r for r in rows if r[0] == "a" and r[6] == 1 and r[3] <= late]
    scores = []
    for b in range(1, BOOTSTRAP_B + 1):
        at = 8 * ((b - 1) % 4)  # four replicates share a digest
        u = [int(hashlib.md5(f"{SEED}|{(b - 1) // 4}|{r[1]}:{r[2]}".encode()).hexdigest()[at:at + 8], 16) / 2 ** 32 for r in mine]
        k = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(j) for j in range(18)]), u, side="right")
        w = k * np.array([r[5] for r in mine])
        scores.append(((w * [r[4] for r in mine]).sum() / w.sum() - 0.3) / 0.7)
    assert len(mine) >= 50
    assert got["a"]["ils_dl_ci_low"] == pytest.approx(np.percentile(scores, 2.5), abs=1e-6)
    assert got["a"]["ils_dl_ci_high"] == pytest.approx(np.percentile(scores, 97.5), abs=1e-6)
    assert got["a"]["exclusion_reason"] == "" and got["b"]["exclusion_reason"] == "low_trade_count" and got["c"]["exclusion_reason"] == "edge_effect"
    assert got["b"]["ils_dl_ci_low"] is None and got["c"]["ils_dl_ci_high"] is None and len(got) == 3


def test_close_values_are_cut_into_ranges(spark, monkeypatch):
    """A group of close doubles spreads over many partitions; groups keep exact ranks when partitions are made anew."""
    monkeypatch.setattr(rk, "PER_RANGE", 500)
    df = spark.range(20000).select(F.when(F.col("id") % 4 == 0, F.lit(None).cast("string")).otherwise("g").alias("g"), (F.lit(0.5) + F.col("id") * F.lit(1e-12)).alias("x"), "id")
    df = df.unionByName(df.where("id % 10 = 0"))
    got = {(r["g"], r["value"]): (r["n"], r["below"], r["total"]) for r in rk.ranked_values(df, ["g"], "x").collect()}
    want, rows = {}, sorted(((r["g"], r["x"]) for r in df.collect()), key=lambda r: (r[0] or "", r[1]))
    for g in (None, "g"):
        xs = [x for h, x in rows if h == g]
        for k, x in enumerate(xs):
            n, below, _ = want.get((g, x), (0, k, 0))
            want[g, x] = (n + 1, below, len(xs))
    assert got == want
    parts = rk._in_ranges(df.groupBy("g", F.col("x").alias("value")).agg(F.count("*").alias("n")), ["g"], 50).groupBy("_part").count().collect()
    assert len(parts) > 40 and max(r["count"] for r in parts) < 1000


@pytest.mark.parametrize("portable", [True, False])
@pytest.mark.parametrize("rows,chunk,groups", [(20_000, 2_000, 1_000), (60, 7, 1)])
def test_replicates_against_brute_force(spark, monkeypatch, portable, rows, chunk, groups):
    """Counts are Poisson draws of (seed, row, replicate): sums by hand, and mean and variance as resampling theory has them."""
    for name, value in (("ROWS", rows), ("CHUNK", chunk), ("GROUPS", groups)):
        monkeypatch.setattr(rs, name, value)
    rng = np.random.default_rng(4)
    data = [(f"r{k}", None if k % 3 == 0 else "a|b" if k % 3 == 1 else "a", "c" if k % 3 == 1 else "b|c", float(rng.normal(5, 2)), float(rng.uniform(1, 4))) for k in range(600)]
    df = spark.createDataFrame(data, "id string, g string, h string, x double, w double").repartition(5)
    got = {(r["g"], r["h"], r["b"]): r["mean"] for r in rs.replicate_means(df, ["g", "h"], "id", "x", "w", 400, portable=portable).collect()}
    assert len(got) == 3 * 400
    for g, h in {(r[1], r[2]) for r in data}:
        mine = [r for r in data if r[1:3] == (g, h)]
        x, w = (np.array([r[j] for r in mine]) for j in (3, 4))
        reps = np.array([got[g, h, b] for b in range(1, 401)])
        if portable:
            k = rs.poisson_counts(rs.uniforms([r[0] for r in mine], 400, SEED, True))
            assert np.allclose(reps, (k * (w * x)[:, None]).sum(0) / (k * w[:, None]).sum(0))
        mean = (w * x).sum() / w.sum()
        sd = math.sqrt((w * w * (x - mean) ** 2).sum()) / w.sum()
        assert abs(reps.mean() - mean) < 4 * sd / 20 and 0.85 < reps.std() / sd < 1.15
    k = rs.poisson_counts(rs.uniforms(list(range(2000)) if portable else np.arange(2000), 500, 7, portable))
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs(np.corrcoef(k[:, 0], k[:, 1])[0, 1]) < 0.08
    assert rs.replicate_means(df.limit(0), ["g"], "id", "x", replicates=5).count() == 0


def test_bitmaps_count_distinct_keys_and_merge_by_day(spark):
    from tidemark.operators import distinct
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][int(rng.integers(3))], f"m{int(rng.integers(90000))}" if rng.random() < 0.97 else None, int(rng.integers(5)), int(rng.integers(10))) for _ in range(60000)]
    df = spark.createDataFrame([*rows, ("none", None, 0, 0)], "g string, m string, day int, x int")
    conditions = {"every": F.lit(True), "large": F.col("x") > 6}
    want = {g: (len({r[1] for r in rows if r[0] == g and r[1]}), len({r[1] for r in rows if r[0] == g and r[1] and r[3] > 6})) for g in ("a", "b", None)} | {"none": (0, 0)}
    assert {r.g: (r.every, r.large) for r in distinct.distinct_counts(df, ["g"], "m", conditions).collect()} == want
    numbers = distinct.dense_numbers(df, "m")
    assert sorted(r.number for r in numbers.collect()) == list(range(1, numbers.count() + 1)) and numbers.count() > 32768  # over one bucket
    daily = distinct.bitmaps(df, ["g", "day"], "m", numbers, conditions)
    merged = distinct.merge_bitmaps(daily, ["g"], list(conditions))
    assert {r.g: (r.every, r.large) for r in distinct.bitmap_counts(merged, ["g"], list(conditions)).collect()} == want
    assert distinct.distinct_counts(df.limit(0), ["g"], "m", conditions).count() == 0


def test_simulated_distances_are_those_of_every_point(monkeypatch):
    import numpy as np
    from math import erf, sqrt

    def plain(dist, n, parts):
        e = fits._rng(*parts).standard_exponential(n + 1)
        u = np.cumsum(e)[:-1] / e.sum()
        if dist == "lognormal":
            z = fits._normal_quantile(u)
            f = np.array([0.5 * (1 + erf((x - z.mean()) / (z.std() * sqrt(2)))) for x in z])
        else:
            f = -np.expm1(-(x := -np.log1p(-u)) / x.mean())
        i = np.arange(1, n + 1)
        return max((i / n - f).max(), (f - (i - 1) / n).max())

    for n in (1, 2, 257, 1400, 5000):
        for dist in ("exponential", "lognormal") if n > 1 else ("exponential",):
            parts = (1, "cell", dist, n)
            want = plain(dist, n, parts)
            assert fits._distance(dist, n, parts, 1_000_000) == pytest.approx(want, abs=1e-9)
        kept = fits._distance("weibull", n, (2, "w", n), 700) if n > 2 else 0.0
        draws = []
        rng = fits._rng
        with monkeypatch.context() as m:
            m.setattr(fits, "_rng", lambda *a: draws.append(a) or rng(*a))
            assert n <= 2 or fits._distance("weibull", n, (2, "w", n), 700) == kept and len(draws) == 1  # a sample of several chunks is drawn once
            m.setattr(fits, "KEPT", 1)
            assert n <= 2 or fits._distance("weibull", n, (2, "w", n), 700) == kept


def test_intervals_of_proportions_are_taken_for_many_rows_at_once(spark, monkeypatch):
    import pandas as pd
    made = {}
    monkeypatch.setattr(rs.F, "pandas_udf", lambda kind: lambda f: made.setdefault("f", f) and (lambda *c: F.lit(None)))
    rs.proportion_interval(F.lit(1), F.lit(1), F.lit("k"), replicates=50, seed=3)
    calls = []
    plain = np.percentile
    monkeypatch.setattr(np, "percentile", lambda *a, **k: calls.append(1) or plain(*a, **k))
    n = pd.Series([10.0 + k for k in range(600)] + [None, 0.0, 5.0])
    got = made["f"](n, n // 3, pd.Series([f"c{k}" for k in range(603)]))
    assert len(calls) == 3  # 601 rows in blocks of 256
    for k in (0, 255, 256, 599, 602):
        d = rs._rng(3, f"c{k}").binomial(int(n[k]), (n[k] // 3) / n[k], 50) / n[k]
        assert tuple(got.iloc[k]) == (plain(d, 2.5), plain(d, 97.5))
    assert got.iloc[600:602].isna().all().all()


def test_portable_draws_are_digests_and_counts_follow_the_cuts():
    """Digests as any engine makes them; counts at, just below and beyond every cut."""
    ids = ["0xab:1", "", "é", 7]
    u = rs.uniforms(ids, 6, 5, True)
    want = [[int.from_bytes(hashlib.md5(f"5|{b // 4}|{i}".encode()).digest()[b % 4 * 4:][:4], "big") / 2 ** 32 for b in range(6)] for i in ids]
    assert u.tolist() == want
    cuts = np.array(rs._CUTS)
    at = np.concatenate([cuts, np.nextafter(cuts, 0), np.nextafter(cuts, 2), [0.0, 1.0]]).reshape(2, -1)
    assert (rs.poisson_counts(at) == np.searchsorted(cuts, at, side="right")).all()

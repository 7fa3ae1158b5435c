"""Hazard fits, goodness of fit and two-sample tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import KS_BOOTSTRAP_B, SEED
from tidemark.operators.hot import attach
from tidemark.operators.ranks import percentiles, ranked_values, with_ranks
from tidemark.operators.resample import _rng
from tidemark.session import staged

CELL = ["category", "subcategory", "period"]
DISTS = ["exponential", "weibull", "lognormal"]
#: numbers of a simulated sample that a task keeps between its passes
KEPT = 8_000_000


def erfc(x: Column) -> Column:
    """Complementary error function, which Spark does not have, in built-in arithmetic.

    Below one the power series of erf; above it the trapezoid rule of its integral form with step 1/2, whose error the last
    term takes away below 2 pi. Both are right to about 1e-15. NULL stays NULL.
    """
    h, a = 0.5, F.abs(x.cast("double"))
    sq = a * a
    series = F.lit(0.0)
    for k in range(22, -1, -1):  # nested, from the smallest term
        series = series * sq + F.lit((-1) ** k / (math.factorial(k) * (2 * k + 1)))
    rule = F.lit(1.0) / sq
    for k in range(1, 13):
        rule = rule + F.lit(2 * math.exp(-(k * h) ** 2)) / (sq + F.lit((k * h) ** 2))
    far = F.lit(h / math.pi) * a * F.exp(-sq) * rule
    pole = F.lit(2.0) / (F.exp(F.lit(2 * math.pi / h) * a) - 1)
    tail = (F.when(a < 1, 1 - F.lit(2 / math.sqrt(math.pi)) * a * series).when(a < math.pi / h, far - pole)
            .when(a < 28, far).when(a.isNotNull(), 0.0))
    return F.when(x < 0, 2 - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * erfc(-z / math.sqrt(2.0))


def positive_delays(population: DataFrame) -> DataFrame:
    return population.where(F.col("in_scope") & (F.col("tau_days") > 0))


def hazard_exponential(delays: DataFrame, groups: list[str] = CELL, least: int = 20) -> DataFrame:
    """Rate, half-life and quartiles of the delay per group."""
    x, n = F.col("value").cast("double"), F.col("n")
    p = percentiles(delays, groups, "tau_days", {"tau_p25": 0.25, "tau_p50": 0.5, "tau_p75": 0.75},
                    [(F.sum(x * n) / F.sum(n)).alias("mean_tau_days")])
    return (p.where(F.col("total") >= least).withColumnRenamed("total", "n")
            .withColumn("lambda_hat", 1.0 / F.col("mean_tau_days"))
            .withColumn("half_life_days", math.log(2.0) * F.col("mean_tau_days")))


def _log_counts(delays: DataFrame, groups: list[str]) -> DataFrame:
    """The table that all fits read, written: number of rows per group and logarithm of the delay."""
    return staged(delays.groupBy(*groups, F.log(F.col("tau_days").cast("double")).alias("_l")).agg(F.count("*").cast("double").alias("_c")))


def _weibull_shape(logs: DataFrame, groups: list[str], stats: DataFrame, rounds: int = 3, first: int = 32, points: int = 16) -> DataFrame:
    """Maximum-likelihood shape per group.

    The score equation is monotone in the shape. A round evaluates it on a grid between the current bounds in one pass, in which every
    grid point is a pair of sums, keeps the sub-interval where the sign changes, and the last one is cut linearly. Values are
    divided by their geometric mean, which keeps the powers tame.
    """
    y = attach(logs, stats.select(*groups, "mean_log"), groups).select(*groups, (F.col("_l") - F.col("mean_log")).alias("_ly"), "_c")
    grid = [F.lit(0.02 * (60.0 / 0.02) ** (j / first)) for j in range(first + 1)]
    bounds = None
    for i in range(rounds + 1):
        rows, held = y, []
        if i:
            rows, held = attach(y, bounds, groups), ["lo", "hi"]
            grid = [F.col("lo") + (F.col("hi") - F.col("lo")) * (j / points) for j in range(points + 1)]
        sums = []
        for j, k in enumerate(grid):
            p = F.col("_c") * F.exp(k * F.col("_ly"))
            sums += [F.sum(p).alias(f"_p{j}"), F.sum(p * F.col("_ly")).alias(f"_q{j}")]
        g = rows.groupBy(*groups, *held).agg(*sums)
        at = F.array(*[F.struct(k.alias("k"), (F.col(f"_q{j}") / F.col(f"_p{j}") - 1.0 / k).alias("g")) for j, k in enumerate(grid)])
        g = g.select(*groups, at.alias("at")).select(*groups, F.array_max(F.filter("at", lambda s: s["g"] <= 0)).alias("a"), F.array_min(F.filter("at", lambda s: s["g"] > 0)).alias("b"))
        g = g.where("a is not null and b is not null")
        shape = g.select(*groups, (F.col("a.k") - F.col("a.g") * (F.col("b.k") - F.col("a.k")) / (F.col("b.g") - F.col("a.g"))).alias("shape"))
        bounds = g.select(*groups, F.col("a.k").alias("lo"), F.col("b.k").alias("hi"))
    power = (attach(y, shape, groups).groupBy(*groups, "shape")
             .agg(F.sum(F.col("_c") * F.exp(F.col("shape") * F.col("_ly"))).alias("_s"), F.sum("_c").alias("_n")))
    return power.select(*groups, "shape", (F.log(F.col("_s") / F.col("_n")) / F.col("shape")).alias("_log_scale0"))


def functional_forms(delays: DataFrame, groups: list[str] = CELL, least: int = 20, weibull: bool = True) -> DataFrame:
    """Log-likelihood, AIC and BIC per group and form, with the fitted parameters."""
    logs, c, lx = _log_counts(delays, groups), F.col("_c"), F.col("_l")
    mean = F.sum(c * lx) / F.sum(c)
    stats = staged(logs.groupBy(*groups).agg(
        F.sum(c).cast("bigint").alias("n"), (F.sum(c * F.exp(lx)) / F.sum(c)).alias("mean_tau"), mean.alias("mean_log"),
        F.sqrt(F.greatest(F.sum(c * lx * lx) / F.sum(c) - mean * mean, F.lit(0.0))).alias("sd_log")).where(F.col("n") >= least))
    n = F.col("n")
    none = F.lit(None).cast("double")
    exp_ll = -n * (F.log("mean_tau") + 1.0)
    log_ll = -n * (F.col("mean_log") + F.log("sd_log") + 0.5 * math.log(2 * math.pi) + 0.5)
    rows = [stats.select(*groups, "n", F.lit("exponential").alias("distribution"), F.lit(1).alias("n_params"), exp_ll.alias("log_lik"),
                         F.col("mean_tau").alias("scale"), none.alias("shape")),
            stats.select(*groups, "n", F.lit("lognormal").alias("distribution"), F.lit(2).alias("n_params"), log_ll.alias("log_lik"),
                         F.exp("mean_log").alias("scale"), F.col("sd_log").alias("shape"))]
    if weibull:
        w = attach(stats, _weibull_shape(logs, groups, stats), groups)
        log_scale = F.col("mean_log") + F.col("_log_scale0")
        ll = n * (F.log("shape") - F.col("shape") * log_scale + (F.col("shape") - 1) * F.col("mean_log") - 1.0)
        rows.append(w.select(*groups, "n", F.lit("weibull").alias("distribution"), F.lit(2).alias("n_params"), ll.alias("log_lik"),
                             F.exp(log_scale).alias("scale"), "shape"))
    df = rows[0]
    for r in rows[1:]:
        df = df.unionByName(r)
    return (df.withColumn("aic", 2.0 * F.col("n_params") - 2.0 * F.col("log_lik"))
            .withColumn("bic", F.col("n_params") * F.log("n") - 2.0 * F.col("log_lik")))


def best_form(forms: DataFrame, groups: list[str] = CELL, prefer_simpler_within: float | None = None) -> DataFrame:
    """Form of the lowest AIC and its lead over the runner-up; a group has at most three rows."""
    order = F.sort_array(F.collect_list(F.struct("aic", "distribution", "n_params")))
    a = forms.groupBy(*groups).agg(order.alias("_f"))
    first = F.col("_f")[0]
    if prefer_simpler_within is not None:
        close = F.filter("_f", lambda f: f["aic"] - F.col("_f")[0]["aic"] < prefer_simpler_within)
        first = F.sort_array(F.transform(close, lambda f: F.struct(f["n_params"].alias("p"), f["aic"].alias("aic"),
                                                                  f["distribution"].alias("distribution"))))[0]
    second = F.coalesce(F.get("_f", F.lit(1)), F.col("_f")[0])
    return a.select(*groups, first["distribution"].alias("winner"), F.round(second["aic"] - F.col("_f")[0]["aic"], 3).alias("aic_delta"))


def fitted_cdf(x: Column) -> Column:
    """CDF of the form named in ``distribution`` with columns scale and shape."""
    z = F.log(x / F.col("scale"))
    return (F.when(F.col("distribution") == "exponential", 1.0 - F.exp(-x / F.col("scale")))
            .when(F.col("distribution") == "weibull", 1.0 - F.exp(-F.pow(x / F.col("scale"), F.col("shape"))))
            .otherwise(normal_cdf(z / F.col("shape"))))


def kolmogorov_p(d: Column, n: Column, terms: int = 40) -> Column:
    """Tail of the Kolmogorov distribution with the usual finite-sample factor."""
    root = F.sqrt(n.cast("double"))
    x = (root + 0.12 + 0.11 / root) * d
    s = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(1, terms + 1)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def forms_with_ks(delays: DataFrame, groups: list[str] = CELL, least: int = 20) -> DataFrame:
    """The form table with ``ks`` and ``ks_pvalue`` beside each form."""
    forms = staged(functional_forms(delays, groups, least))
    ks = ks_statistic(delays, forms, groups).drop("n")
    return attach(forms, ks, [*groups, "distribution"])


def ks_statistic(delays: DataFrame, forms: DataFrame, groups: list[str] = CELL) -> DataFrame:
    """Largest distance of the empirical from the fitted distribution, per group and form."""
    ranked = ranked_values(delays, groups, "tau_days").withColumnRenamed("n", "copies")
    j = attach(ranked, forms, groups)
    f = fitted_cdf(F.col("value").cast("double"))
    total = F.col("total").cast("double")
    gap = F.greatest(f - F.col("below") / total, (F.col("below") + F.col("copies")) / total - f)
    d = j.groupBy(*groups, "distribution").agg(F.max(gap).alias("ks"), F.max("total").alias("n"))
    return d.withColumn("ks_pvalue", kolmogorov_p(F.col("ks"), F.col("n")))


def _spacings(n: int, seed_parts: tuple, chunk: int) -> Iterator[np.ndarray]:
    """The n + 1 exponential spacings of a sample, in chunks; the same numbers on every call."""
    rng = _rng(*seed_parts)
    for at in range(0, n + 1, chunk):
        yield rng.standard_exponential(min(chunk, n + 1 - at))


def _sorted_uniforms(spacings, total: float, n: int) -> Iterator[np.ndarray]:
    """n sorted uniform numbers in chunks, from all their spacings and these' sum."""
    run, at = 0.0, 0
    for x in spacings:
        s = run + np.cumsum(x)
        run, at = s[-1], at + len(x)
        yield (s if at < n + 1 else s[:-1]) / total


# fixed values: rational approximation of the inverse normal distribution (P. J. Acklam)
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    u = np.clip(u, 1e-300, 1 - 1e-16)
    q = u - 0.5
    out, inner = np.empty_like(q), np.abs(q) <= 0.47575
    m, outer = q[inner], ~inner  # each form only where it holds
    out[inner] = m * np.polyval(_A, m * m) / np.polyval(_B, m * m)
    t = np.sqrt(-2 * np.log(np.minimum(u[outer], 1 - u[outer])))
    tail = np.polyval(_C, t) / np.polyval(_D, t)
    out[outer] = np.where(q[outer] < 0, tail, -tail)
    return out


def _largest_gap(x: np.ndarray, at: int, n: int, cdf, least: float = 0.0, step: int = 256) -> float:
    """Largest distance of ``cdf`` from the steps at the sorted points ``x``, which are those from ``at`` on of n; ``least`` if none is larger.

    The function rises, so its values at both ends of a run of ``step`` points bound the distances between; only runs that
    could hold a larger one are looked into.
    """
    def gap(i: np.ndarray, f: np.ndarray) -> float:
        return max(np.max((at + i + 1) / n - f), np.max(f - (at + i) / n))

    ends = np.r_[np.arange(0, len(x) - 1, step), len(x) - 1]
    f = cdf(x[ends])
    d = max(least, gap(ends, f))
    bound = np.maximum((at + ends[1:]) / n - f[:-1], f[1:] - (at + ends[:-1]) / n)
    inside = [np.arange(a + 1, b) for a, b in zip(ends[:-1][bound > d - 1e-12], ends[1:][bound > d - 1e-12]) if b > a + 1]
    return max(d, gap(i := np.concatenate(inside), cdf(x[i]))) if inside else d


def _distance(dist: str, n: int, parts: tuple, chunk: int) -> float:
    """Distance of one simulated and refitted sample; location and scale drop out, so a standard one is drawn.

    A sample of up to ``KEPT`` numbers is drawn once and kept; a longer one is drawn again for every pass.
    """
    spacings = list(_spacings(n, parts, chunk)) if n < KEPT else None
    drawn = lambda: _spacings(n, parts, chunk) if spacings is None else spacings
    total = 0.0
    for x in drawn():
        total += x.sum()

    def passes(transform):
        stream = lambda: (transform(u) for u in _sorted_uniforms(drawn(), total, n) if len(u))
        if spacings is not None:
            kept = list(stream())
            spacings.clear()
            return lambda: kept
        return stream

    if dist == "lognormal":
        _erf = np.frompyfunc(math.erf, 1, 1)
        xs = passes(_normal_quantile)
        mu = sum(z.sum() for z in xs()) / n
        sd = math.sqrt(max(sum((z * z).sum() for z in xs()) / n - mu * mu, 1e-300))
        cdf = lambda z: 0.5 * (1 + _erf((z - mu) / (sd * math.sqrt(2))).astype(float))
    else:
        xs = passes(lambda u: np.log(-np.log1p(-np.minimum(u, 1 - 1e-16))))
        k = 1.0
        if dist == "weibull":
            ml = sum(lx.sum() for lx in xs()) / n
            for _ in range(30):
                a = b = c = 0.0
                for lx in xs():
                    p = np.exp(k * lx)
                    q = p * lx
                    a, b, c = a + p.sum(), b + q.sum(), c + (q * lx).sum()
                g, dg = b / a - 1 / k - ml, c / a - (b / a) ** 2 + 1 / (k * k)
                step = g / dg
                k = max(k - step, k / 4)
                if abs(step) < 1e-8:
                    break
        scale_k = sum(np.exp(k * lx).sum() for lx in xs()) / n
        cdf = lambda lx: -np.expm1(-np.exp(k * lx) / scale_k)
    d, at = 0.0, 0
    for x in xs():
        d, at = _largest_gap(x, at, n, cdf, d), at + len(x)
    return float(d)


def ks_parametric_bootstrap(ks: DataFrame, groups: list[str] = CELL, replicates: int = KS_BOOTSTRAP_B, seed: int = SEED,
                            least: int = 5, block: int = 37, chunk: int = 1_000_000) -> DataFrame:
    """Share of refitted simulated samples at least as far off as the observed one.

    ``ks`` comes from ``ks_statistic``. Replicates are spread over the cluster in blocks; a sample is
    simulated in sorted chunks, of which ``KEPT`` numbers are held, so memory does not grow with the cell beyond that.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("␀")) for g in groups])
    blocks = -(-replicates // block)
    jobs = (ks.where(F.col("n") >= least).withColumn("_g", key)
            .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    # the rows are few and the work per row is long: a fixed number of partitions is not merged again
    jobs = jobs.repartition(3 * ks.sparkSession.sparkContext.defaultParallelism, "_g", "distribution", "_blk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for g, dist, n, d0, blk in zip(pdf["_g"], pdf["distribution"], pdf["n"], pdf["ks"], pdf["_blk"]):
                reps = range(blk * block, min((blk + 1) * block, replicates))
                hits.append(sum(_distance(dist, int(n), (seed, g, dist, b), chunk) >= d0 for b in reps))
            yield pd.DataFrame({"_g": pdf["_g"], "distribution": pdf["distribution"], "hits": hits})

    hits = jobs.select("_g", "distribution", "n", "ks", "_blk").mapInPandas(run, "_g string, distribution string, hits bigint")
    total = hits.groupBy("_g", "distribution").agg(F.sum("hits").alias("hits"))
    return (ks.withColumn("_g", key).join(total, ["_g", "distribution"], "left").drop("_g")
            .withColumn("ks_pvalue_bootstrap", F.round((1.0 + F.col("hits")) / (replicates + 1.0), 4)))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Two-sided rank test of two groups: U of the first, normal p with tie and continuity correction, effect size."""
    two = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(group, value)
    ranked = ranked_values(two, [], value)
    ranks = with_ranks(two, [], value, ranked=ranked)
    ties = ranked.agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    is1 = F.col(group) == first
    a = ranks.agg(F.sum(F.when(is1, F.col("avg_rank"))).alias("r1"), F.count_if(is1).alias("n1"), F.count_if(~is1).alias("n2"))
    from tidemark.operators.audits import one_row
    j = one_row(a, ties)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u, n = F.col("r1") - n1 * (n1 + 1) / 2, n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    return j.select(u.alias("u"), "n1", "n2", z.alias("z"), erfc(z / math.sqrt(2.0)).alias("p"), (z / F.sqrt(n)).alias("r"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, d, c = 1e-300, 1 - (a + b) * x / (a + 1), 1.0
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial variable."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b = float(k), float(n - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log(1 - p))
    if p < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, p) / a
    return 1 - front * _beta_fraction(b, a, 1 - p) / b


def binomial_tail_of(k: Column, n: Column, p: Column) -> Column:
    @F.pandas_udf("double")
    def run(ks: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(b) or b <= 0 else binomial_tail(int(a), int(b), float(c))
                          for a, b, c in zip(ks, ns, ps)], dtype="float64")

    return run(k, n, p)


def binomial_concordance(localised: DataFrame) -> DataFrame:
    """Observed against expected case markets in the top shares of their cells, with the exact one-sided p."""
    tops = {"top_10": 0.10, "top_5": 0.05, "top_1": 0.01}
    one = localised.where("in_top_10 is not null").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"in_{t}")).alias(t) for t in tops])
    long = one.unpivot(["n"], list(tops), "threshold", "observed")
    p = F.when(F.col("threshold") == "top_10", 0.10).when(F.col("threshold") == "top_5", 0.05).otherwise(0.01)
    return long.withColumn("expected", F.round(F.col("n") * p, 2)) \
        .withColumn("p_value", F.round(binomial_tail_of(F.col("observed"), F.col("n"), p), 4))

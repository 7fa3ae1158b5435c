"""The population study: scored markets, their scope, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.numeric import days_between
from tidemark.functions.text import classify_regulatory
from tidemark.operators import filters as fi
from tidemark.operators.hot import attach, join_hot
from tidemark.operators.ranks import finish_moments, moments, percentiles, percentiles_of, ranked_values, with_ranks
from tidemark.operators.resample import score_interval
from tidemark.operators.history import History
from tidemark.operators.series import quote_bounds, store_history
from tidemark.session import staged
from tidemark.plans.scoring import deadline_refs, score

CELL = ["category", "subcategory", "period"]
VARIANTS = ["ils_dl", "ils_dl_30min", "ils_dl_2h", "ils_dl_6h", "ils_dl_24h"]


def proxy_news(markets: DataFrame) -> DataFrame:
    """A stand-in news time one day before resolution."""
    return markets.select("market_id", (F.col("t_resolve") - F.expr("interval 24 hours")).alias("t_news"),
                          F.lit(2).alias("tier"), F.lit(str(C.CONFIDENCE_PROXY)).cast("decimal(3,2)").alias("confidence"),
                          F.lit("proxy:resolve-24h:control").alias("notes"))


def population_scores(markets: DataFrame, events: DataFrame, prices: DataFrame, trades: DataFrame, history: History | None = None) -> DataFrame:
    """One row per market of a prefiltered universe with score, scope and exclusion reason.

    ``events`` holds recovered events (market_id, t_event, confidence, n_sources). Scores use quotes
    only, with a minute-before-event reference. ``history`` is a stored one of these prices; without it one is stored.
    """
    m = fi.prefilter_scope(markets).withColumnRenamed("exclusion_reason", "_pre")
    e = events.select("market_id", "t_event", F.col("confidence").alias("t_event_confidence"), "n_sources")
    bars = history or store_history(prices, trades.where("false"))
    bounds = quote_bounds(bars)
    base = staged(m.join(e, "market_id", "left").join(bounds.select("market_id", F.col("n_points").alias("n_quotes")), "market_id", "left"))
    good = base.where((F.col("t_event_confidence") >= C.CONFIDENCE_THRESHOLD) & (F.col("_pre") == "")
                      & (F.col("t_event") > F.col("t_open")))
    refs = deadline_refs(good.drop("t_event"), good.select("market_id", "t_event"))
    s = score(refs, bars, bounds).select(
        "market_id", "status", F.col("p_open").cast("double").alias("p_open"),
        F.col("p_ref").cast("double").alias("p_event"), "ils", "ils_30min", "ils_2h", "ils_6h", "ils_24h", "flags")
    j = base.join(s, "market_id", "left").withColumn("tau_days", days_between(F.col("t_event"), F.col("t_open"))) \
        .withColumn("p_resolve", F.col("outcome"))
    out = fi.scope_cascade(j)
    in_scope = F.col("in_scope")
    keep = lambda c: F.when(in_scope, F.col(c).cast("double"))
    late = F.col("exclusion_reason").isin("edge_effect", "trivial_resolution")
    recovered = F.col("t_event").isNotNull() & (F.col("t_event_confidence") >= C.CONFIDENCE_THRESHOLD) & (F.col("_pre") == "")
    return out.select(
        "market_id", "question", "category",
        F.when(F.col("category") == "regulatory_decision", classify_regulatory(F.col("question"))).alias("subcategory"),
        "resolution_type", fi.period_bucket(F.col("t_resolve")).alias("period"), "t_open",
        F.when(recovered, F.col("t_event")).alias("t_event"),
        F.when(F.col("_pre") == "", F.col("t_event_confidence")).alias("t_event_confidence"), "n_sources", "t_resolve",
        F.when(recovered, F.col("tau_days")).alias("tau_days"), F.col("volume").alias("volume_usdc"),
        F.when(in_scope | late, F.col("p_open")).alias("p_open"), keep("p_event").alias("p_event"), "p_resolve",
        keep("ils").alias("ils_dl"), keep("ils_30min").alias("ils_dl_30min"), keep("ils_2h").alias("ils_dl_2h"),
        keep("ils_6h").alias("ils_dl_6h"), keep("ils_24h").alias("ils_dl_24h"), "in_scope", "exclusion_reason")


def with_intervals(population: DataFrame, trades: DataFrame, portable: bool = False) -> DataFrame:
    """``population`` (written before, as it is read twice) with ``ils_dl_ci_low`` and ``ils_dl_ci_high``.

    An in-scope market without an interval keeps its score and gets the reason ``low_trade_count``.
    """
    scored = population.where("in_scope")
    ci = score_interval(trades, scored.select("market_id", "t_open", "t_event", "p_open", "p_resolve"), portable=portable)
    j = population.join(ci.select("market_id", F.col("ci_low").alias("ils_dl_ci_low"), F.col("ci_high").alias("ils_dl_ci_high")), "market_id", "left")
    low = F.col("in_scope") & F.col("ils_dl_ci_low").isNull()
    return j.withColumn("exclusion_reason", F.when(low, "low_trade_count").otherwise(F.col("exclusion_reason")))


def computed(population: DataFrame) -> DataFrame:
    """In-scope rows with a score."""
    return population.where(F.col("in_scope") & F.col("ils_dl").isNotNull())


def with_regulatory_subcategory(population: DataFrame) -> DataFrame:
    return population.withColumn("subcategory", F.when(F.col("category") == "regulatory_decision",
                                                       classify_regulatory(F.col("question"))))


def review_sample(population: DataFrame, n: int = 50) -> DataFrame:
    """Seeded sample of regulatory rows with blank review columns."""
    reg = with_regulatory_subcategory(population.where("category = 'regulatory_decision'"))
    return fi.random_sample(reg.select("market_id", "question", "subcategory"), "market_id", n) \
        .withColumn("manual_subcategory", F.lit("")).withColumn("agreement", F.lit(""))


def anchor_flags(population: DataFrame) -> DataFrame:
    """Is a score stable over its reference windows? Sign changes and a range above 0.3 count against it."""
    vals = F.filter(F.array(*VARIANTS), lambda x: x.isNotNull())
    pos, neg = F.exists(vals, lambda x: x >= 0), F.exists(vals, lambda x: x < 0)
    spread = F.array_max(vals) - F.array_min(vals)
    reason = (F.when(F.size(vals) < 2, "").when(pos & neg, "sign_flip")
              .when(spread > 0.3, F.concat(F.lit("spread_"), F.format_number(spread, 2))).otherwise(""))
    return computed(population).withColumn("anchor_failure_reason", reason) \
        .withColumn("anchor_robust", F.col("anchor_failure_reason") == "")


def spearman(df: DataFrame, groups: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Rank correlation per group from tie-averaged ranks; NULL below ``least`` pairs."""
    paired = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, a, b)
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("x")), F.struct(F.lit("b").alias("side"), F.col(b).alias("x"))))
    ranked = ranked_values(paired.select(*groups, sides.alias("s")).select(*groups, "s.side", "s.x"), [*groups, "side"], "x")  # both columns in one pass
    r = with_ranks(paired, groups, a, "a_", ranked.where("side = 'a'"))
    r = with_ranks(r, groups, b, "b_", ranked.where("side = 'b'"))
    return r.groupBy(*groups).agg(
        F.count("*").alias("n_pairs"),
        F.when(F.count("*") >= least, F.corr("a_avg_rank", "b_avg_rank")).alias("spearman"))


def verdict(rho: Column) -> Column:
    return F.when(rho > 0.7, "robust").when(rho > 0.4, "moderate").otherwise("sensitive")


def anchor_summary(population: DataFrame) -> DataFrame:
    flagged = anchor_flags(population)
    n = flagged.groupBy("category").agg(F.count("*").alias("n_total"), F.count_if("anchor_robust").alias("n_anchor_robust"))
    rho = spearman(flagged, ["category"], "ils_dl", "ils_dl_24h").drop("n_pairs")
    return (n.join(rho, "category", "left")
            .withColumn("pct_anchor_robust", F.round(100.0 * F.col("n_anchor_robust") / F.col("n_total"), 1))
            .withColumn("spearman", F.round("spearman", 4)))


def hazard_adjusted(population: DataFrame, min_cell: int = 5) -> DataFrame:
    """Remove the price drift a deadline alone would explain.

    The rate comes from the cell when it has enough delays, else from all scored rows. The expected
    price follows exponential survival over the time left and the whole life of the market.
    """
    c = computed(population)
    overall = c.agg(F.avg("tau_days")).scalar()
    cells = c.groupBy(*CELL).agg((1 / F.when(F.count("tau_days") >= min_cell, F.avg("tau_days"))).alias("_lam"))
    j = attach(c, cells, CELL).withColumn("lam", F.coalesce("_lam", 1 / overall)).drop("_lam")
    tau_total = days_between(F.col("t_resolve"), F.col("t_open"))
    s = lambda t: F.exp(-F.col("lam") * F.greatest(t, F.lit(0.0)))
    left = F.greatest(tau_total - F.col("tau_days"), F.lit(0.0))
    den = F.lit(1.0) - s(tau_total)
    raw = F.col("p_open") * (s(left) - s(tau_total)) / F.when(den >= 1e-9, den)
    edp = F.when(den < 1e-9, F.col("p_open")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    gap = F.col("p_resolve") - F.col("p_open")
    missing = F.col("t_open").isNull() | F.col("t_resolve").isNull()
    return (j.withColumn("expected_decay_price", F.when(~missing, edp))
            .withColumn("adj_method", F.when(missing, "missing_timestamps").when(F.abs(gap) < 1e-6, "trivial_resolution")
                        .otherwise("exp_hazard"))
            .withColumn("ils_dl_adj", F.when(F.col("adj_method") == "exp_hazard",
                                             (F.col("p_event") - F.col("expected_decay_price")) / gap)))


_SUMMARY = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def hazard_adjusted_summary(adjusted: DataFrame, least: int = 3) -> DataFrame:
    """Raw against adjusted scores per study bucket and period, long by kind of score."""
    df = adjusted.withColumn("bucket", fi.study_bucket(F.col("subcategory"))).select(
        "bucket", "period", F.explode(F.array(
            F.struct(F.lit("raw").alias("kind"), F.col("ils_dl").alias("x")),
            F.struct(F.lit("adj").alias("kind"), F.col("ils_dl_adj").alias("x")))).alias("s")) \
        .select("bucket", "period", "s.kind", "s.x")
    p = percentiles(df, ["bucket", "period", "kind"], "x", _SUMMARY, moments(F.col("value")))
    return finish_moments(p).where(F.col("total") >= least).withColumnRenamed("total", "n")


_QUANTILES = {f"p{q:02d}": q / 100 for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)}


def distribution_summary(population: DataFrame, groups: list[str] = CELL, least: int = 5) -> DataFrame:
    """Moments and percentiles per cell, one row per statistic."""
    p = percentiles(computed(population), groups, "ils_dl", _QUANTILES, moments(F.col("value")))
    wide = finish_moments(p).where(F.col("total") >= least).withColumnRenamed("total", "n").withColumn("median", F.col("p50"))
    stats = ["mean", "median", "std", "skewness", "kurtosis", *_QUANTILES]
    return wide.unpivot([*groups, "n"], stats, "statistic", "value")


def detection_thresholds(population: DataFrame, groups: list[str] = CELL, least: int = 5) -> DataFrame:
    probs = {"top_10": 0.90, "top_5": 0.95, "top_1": 0.99}
    return percentiles(computed(population), groups, "ils_dl", probs).where(F.col("total") >= least) \
        .withColumnRenamed("total", "n")


def tail_review(population: DataFrame, n: int = 10) -> DataFrame:
    """The n largest and n smallest scores, ranked from the top."""
    c = computed(population).select("market_id", "category", "ils_dl")
    both = c.orderBy(F.desc("ils_dl"), "market_id").limit(n).unionByName(
        c.orderBy(F.asc("ils_dl"), "market_id").limit(n)).dropDuplicates(["market_id"])
    w = Window.orderBy(F.desc("ils_dl"), "market_id")  # at most 2n rows
    return both.withColumn("rank", F.row_number().over(w))


def flatten_cases(lines: DataFrame) -> DataFrame:
    """Nested case lines to one row per (case, market prefix)."""
    schema = "case_id string, title string, markets array<struct<market_id_prefix: string, market_id: string>>"
    return (lines.select(F.from_json("line", schema).alias("c")).select("c.case_id", "c.title", F.explode("c.markets").alias("m"))
            .select("case_id", "title", F.coalesce("m.market_id_prefix", "m.market_id", F.lit("")).alias("prefix")))


def first_by_prefix(df: DataFrame, length: int = 10) -> DataFrame:
    """First row (smallest id) per id prefix."""
    cols = [c for c in df.columns if c != "market_id"]
    return (df.groupBy(F.substring("market_id", 1, length).alias("prefix"))
            .agg(F.min(F.struct("market_id", *cols)).alias("r")).select("prefix", "r.*"))


def localise_cases(cases: DataFrame, population: DataFrame, typology: DataFrame) -> DataFrame:
    """Rank of each case market within its cell, or the reason why it has none.

    Prefixes are matched by equality on the first ten characters, against the scored rows first,
    then the whole population, then the typology.
    """
    ranked = with_ranks(computed(population).select("market_id", *CELL, "ils_dl"), CELL, "ils_dl") \
        .select("market_id", *CELL, "ils_dl", "cume", "cell_n")
    hit = first_by_prefix(ranked)
    pop = first_by_prefix(population.select("market_id", "exclusion_reason")).select("prefix", "exclusion_reason")
    typ = first_by_prefix(typology.select("market_id", "category", "resolution_type", F.col("outcome").cast("string"))).select(
        "prefix", F.concat(F.lit("pre_filtered: cat="), F.coalesce("category", F.lit("None")), F.lit(", res_type="),
                           F.coalesce("resolution_type", F.lit("None")), F.lit(", outcome="),
                           F.coalesce("outcome", F.lit("None"))).alias("_typ"))
    # every case may carry an empty prefix, so one key can be as large as the number of cases
    j = cases
    for side in (hit.withColumn("_hit", F.lit(True)), pop, typ):
        j = join_hot(j, side, ["prefix"], "left", ["case_id"])
    note = (F.when(F.col("_hit"), F.when(F.col("cell_n") < 2, "cell_too_small").otherwise(""))
            .when(F.col("exclusion_reason").isNotNull(), F.concat(F.lit("in_population_excluded: "), "exclusion_reason"))
            .when(F.col("_typ").isNotNull(), F.col("_typ"))
            .when(F.col("prefix") != "", "not_in_typology").otherwise("no_market_id"))
    pct = F.when(F.col("cell_n") >= 2, F.col("cume") * 100)
    return j.select("case_id", "prefix", "market_id", *CELL, "ils_dl", F.round(pct, 2).alias("rank_pctile"), "cume", "cell_n",
                    (pct >= 90).alias("in_top_10"), (pct >= 95).alias("in_top_5"), (pct >= 99).alias("in_top_1"),
                    note.alias("note"))

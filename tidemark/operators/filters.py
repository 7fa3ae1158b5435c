"""Selections over markets, wallets and the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C


def target_universe(markets: DataFrame, min_volume: float = C.MIN_VOLUME, resolved: bool = True,
                    yes_only: bool = False) -> DataFrame:
    """Markets of the three studied categories with enough volume."""
    cond = F.col("category").isin(C.TARGET_CATEGORIES) & (F.col("volume") >= min_volume)
    if resolved:
        cond = cond & F.col("t_resolve").isNotNull()
    if yes_only:
        cond = cond & (F.col("outcome") == 1)
    return markets.where(cond)


def prefilter_scope(markets: DataFrame) -> DataFrame:
    """Drop rows without a resolve time or a type; mark deadline markets that resolved to no as out of scope."""
    no = (F.col("resolution_type") == "deadline_resolved") & F.coalesce(F.col("outcome") == 0, F.lit(False))
    return (markets.where(F.col("t_resolve").isNotNull() & (F.col("resolution_type") != "unclassifiable"))
            .withColumn("in_scope", ~no)
            .withColumn("exclusion_reason", F.when(no, "deadline_NO").otherwise("")))


def stale_wallets(wallets: DataFrame, as_of: Column, max_age_days: int) -> DataFrame:
    """Wallets refreshed too long ago, or never seen on chain."""
    cutoff = as_of - F.expr(f"interval {max_age_days} days")
    return wallets.where((F.col("last_refreshed_at") < cutoff) | F.col("first_seen_chain_at").isNull())


def active_stale_wallets(wallets: DataFrame, trades: DataFrame, as_of: Column, max_age_days: int,
                         min_trades: int) -> DataFrame:
    """Stale wallets with at least ``min_trades`` trades as taker."""
    counts = trades.groupBy(F.col("taker_address").alias("address")).agg(F.count("*").alias("n_trades"))
    return stale_wallets(wallets, as_of, max_age_days).join(counts.where(F.col("n_trades") >= min_trades), "address")


def needs_collection(markets: DataFrame, trades: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """What to fetch: nothing for long-resolved markets that have trades; quotes only while they are few."""
    n_t = trades.groupBy("market_id").agg(F.count("*").alias("n_trades"))
    n_p = prices.groupBy("market_id").agg(F.count("*").alias("n_prices"))
    df = (markets.select("market_id", "t_resolve").join(n_t, "market_id", "left").join(n_p, "market_id", "left")
          .fillna(0, ["n_trades", "n_prices"]))
    stale = F.coalesce(as_of - F.expr("interval 24 hours") > F.col("t_resolve"), F.lit(False))
    skip = (F.col("n_trades") > 0) & stale
    return df.select("market_id", "n_trades", "n_prices", (~skip).alias("fetch_trades"),
                     (~skip & (F.col("n_prices") < C.MIN_PRICE_POINTS)).alias("fetch_quotes"))


def evidence_candidates(markets: DataFrame, min_volume: float = C.MIN_VOLUME) -> DataFrame:
    """Event markets without an evidence URL that are large enough to look up."""
    return markets.where((F.col("resolution_type") == "event_resolved") & F.col("evidence_url").isNull()
                         & (F.col("volume") >= min_volume))


def unclassified(markets: DataFrame, column: str, force: bool = False, limit: int | None = None) -> DataFrame:
    """Markets whose ``column`` is still empty (all of them when forced)."""
    df = markets if force else markets.where(F.col(column).isNull())
    return df.orderBy("market_id").limit(limit) if limit else df


def any_keyword(column: str, words: list[str]) -> Column:
    """Case-insensitive substring match against any word."""
    return F.col(column).rlike("(?i)" + "|".join(words))


def suggest_validation_set(markets: DataFrame, limit: int | None = None) -> DataFrame:
    df = markets.where(F.col("outcome").isNotNull() & any_keyword("question", C.SIGNAL_KEYWORDS))
    return df.orderBy("market_id").limit(limit) if limit else df


def url_allowed(url: Column) -> Column:
    """http(s) pages outside the denied hosts."""
    return F.coalesce(F.lower(url).rlike("^https?:") & ~url.rlike(C.DENIED_HOSTS), F.lit(False))


def scope_cascade(df: DataFrame) -> DataFrame:
    """Add ``in_scope`` and ``exclusion_reason``; the first rule that applies decides.

    Needs resolution_type, outcome, t_event, t_event_confidence, tau_days, n_quotes, status, p_open,
    p_resolve, ils and flags.
    """
    p_open, delta = F.col("p_open"), F.coalesce(F.col("p_resolve"), F.lit(0)) - F.coalesce(F.col("p_open"), F.lit(0.5))
    reason = (
        F.when((F.col("resolution_type") == "deadline_resolved") & (F.col("outcome") == 0), "deadline_NO")
        .when(F.col("t_event").isNull() | F.col("t_event_confidence").isNull()
              | (F.col("t_event_confidence") < C.CONFIDENCE_THRESHOLD), "low_confidence_t_event")
        .when(F.col("tau_days") <= 0, "negative_tau")
        .when(F.coalesce(F.col("n_quotes"), F.lit(0)) == 0, "no_quote_coverage")
        .when(F.coalesce(F.col("status"), F.lit("missing")) != "ok", F.concat(
            F.lit("ils_compute_error: "), F.coalesce(F.col("status"), F.lit("missing"))))
        .when(F.abs(p_open - 0.5) >= C.EDGE_DISTANCE, "edge_effect")
        .when(F.abs(delta) < C.TRIVIAL_DELTA, "trivial_resolution")
        .when(F.col("ils").isNull(), F.concat(F.lit("ils_null: "), F.array_join("flags", ",")))
        .otherwise(""))
    return df.withColumn("exclusion_reason", reason).withColumn("in_scope", F.col("exclusion_reason") == "")


def random_sample(df: DataFrame, key: str, n: int, seed: int = C.SEED) -> DataFrame:
    """Uniform sample of n rows, the same on every run: the n smallest hashes of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def period_bucket(t_resolve: Column) -> Column:
    return F.when(F.to_date(t_resolve) < F.lit(C.PERIOD_CUT).cast("date"), "pre_2024").otherwise("post_2024")


def study_bucket(subcategory: Column) -> Column:
    s = F.coalesce(subcategory, F.lit(""))
    return (F.when(s.contains("announcement"), "regulatory_announcement")
            .when(s.contains("formal"), "regulatory_formal").otherwise("other"))


def recovery_route(markets: DataFrame) -> DataFrame:
    """Which time to recover: none for deadline markets that resolved to no."""
    deadline = F.coalesce(F.col("resolution_type") == "deadline_resolved", F.lit(False))
    yes = F.coalesce(F.col("outcome") == 1, F.lit(False))
    return markets.withColumn("route", F.when(deadline & ~yes, "skip").when(deadline, "t_event").otherwise("t_news"))


def recovery_status(df: DataFrame) -> Column:
    """Outcome of an event recovery: none, low confidence, negative delay or accepted."""
    return (F.when(F.col("t_event").isNull(), "none")
            .when(F.col("confidence") < C.CONFIDENCE_THRESHOLD, "low_confidence")
            .when(F.col("t_event") <= F.col("t_open"), "negative_tau").otherwise("accepted"))


def control_candidates(markets: DataFrame, trades: DataFrame, labels: DataFrame, cases: DataFrame,
                       min_trades: int = C.CONTROL_MIN_TRADES, min_volume: float = C.MIN_VOLUME) -> DataFrame:
    """Unclassifiable, well traded markets that carry no label and belong to no case."""
    n = trades.groupBy("market_id").agg(F.count("*").alias("n_trades")).where(F.col("n_trades") >= min_trades)
    return (markets.where((F.col("resolution_type") == "unclassifiable") & (F.col("volume") >= min_volume)
                          & F.col("category").isin(C.TARGET_CATEGORIES)
                          & F.col("t_resolve").isNotNull() & F.col("outcome").isNotNull())
            .join(n, "market_id").join(labels.select("market_id"), "market_id", "left_anti")
            .join(cases.select("market_id"), "market_id", "left_anti"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    agg = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return agg.unpivot([], list(rules), "rule", "violations")

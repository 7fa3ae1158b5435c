"""Leakage scores for all markets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DEADLINE_LOOKBACK_HOURS, EPSILON, TOPEN_SNAP_SECONDS, WINDOWS_MIN
from tidemark.functions.numeric import PRICE, decimal_ratio
from tidemark.operators.features import best_news, label_features
from tidemark.operators.history import History
from tidemark.operators.series import history_bounds, lookup_prices, prepare_series
from tidemark.session import staged

REF_COLUMNS = ["market_id", "t_open", "t_ref", "t_resolve", "p_resolve", "lead_flags"]


def scorable(markets: DataFrame) -> DataFrame:
    """Markets with an outcome and both times."""
    return markets.where("outcome is not null and t_open is not null and t_resolve is not null")


def _no_flags() -> Column:
    return F.array().cast("array<string>")


def standard_refs(markets: DataFrame, news: DataFrame) -> DataFrame:
    """Reference time = best news time."""
    return (scorable(markets).join(best_news(news).select("market_id", F.col("t_news").alias("t_ref")), "market_id")
            .select("market_id", "t_open", "t_ref", "t_resolve", F.col("outcome").alias("p_resolve"),
                    _no_flags().alias("lead_flags")))


def deadline_refs(markets: DataFrame, events: DataFrame, lookback_hours: int = DEADLINE_LOOKBACK_HOURS) -> DataFrame:
    """Reference time = one minute before the recovered event (market_id, t_event), else a fixed lookback.

    A reference at or before the opening falls back to the opening itself.
    """
    m = scorable(markets).join(events.select("market_id", "t_event"), "market_id", "left")
    raw = F.coalesce(F.col("t_event") - F.expr("interval 1 minute"),
                     F.col("t_resolve") - F.expr(f"interval {lookback_hours} hours"))
    early = raw <= F.col("t_open")
    return m.select(
        "market_id", "t_open", F.when(early, F.col("t_open")).otherwise(raw).alias("t_ref"), "t_resolve",
        F.col("outcome").alias("p_resolve"),
        F.array_compact(F.array(F.when(F.col("t_event").isNotNull(), "t_event_recovered"),
                                F.when(early, "lookback_predates_topen"))).alias("lead_flags"))


def snap_open(refs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Move the opening to the first price when that comes more than five minutes later."""
    late = F.unix_micros("first_ts") - F.unix_micros("t_open") > TOPEN_SNAP_SECONDS * 1_000_000
    return (refs.join(bounds.select("market_id", "first_ts"), "market_id")
            .withColumn("t_open_snapped", late)
            .withColumn("t_open", F.when(late, F.col("first_ts")).otherwise(F.col("t_open"))).drop("first_ts"))


def score(refs: DataFrame, series: DataFrame | History, bounds: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Score rows of REF_COLUMNS; markets without any price are left out."""
    return _score(staged(refs), series, bounds, epsilon)


def _score(refs: DataFrame, series: DataFrame | History, bounds: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Score staged references.

    All prices of a market (opening, reference and five window starts) come from one exploded
    lookup table and are folded back with one aggregation.
    """
    kinds = [F.struct(F.lit("open").alias("kind"), F.col("t_open").alias("t"), F.lit(True).alias("forward")),
             F.struct(F.lit("ref").alias("kind"), F.col("t_ref").alias("t"), F.lit(False).alias("forward"))]
    kinds += [F.struct(F.lit(w).alias("kind"), (F.col("t_ref") - F.expr(f"interval {m} minutes")).alias("t"),
                       F.lit(False).alias("forward")) for w, m in WINDOWS_MIN.items()]
    asked = (refs.select("market_id", "t_open", F.explode(F.array(*kinds)).alias("q"))
             .where((F.col("q.kind") == "open") | (F.col("q.kind") == "ref") | (F.col("q.t") >= F.col("t_open")))
             .select("market_id", "q.kind", "q.t", "q.forward"))
    found = lookup_prices(asked, series, bounds).groupBy("market_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("mid_price"))).alias(f"_p_{k}")
          for k in ("open", "ref", *WINDOWS_MIN)])
    eps = F.lit(str(epsilon)).cast(PRICE)
    df = refs.join(found, "market_id").join(bounds.select("market_id", "source"), "market_id")
    one = F.col("p_resolve").cast(PRICE)
    p_open, p_ref = F.col("_p_open"), F.col("_p_ref")
    gap = p_open.isNull() | p_ref.isNull()
    total = one - p_open
    flags = [F.when(F.abs(total) < eps, "low_information_market")]
    windows = []
    for w, m in WINDOWS_MIN.items():
        early = F.col("t_ref") - F.expr(f"interval {m} minutes") < F.col("t_open")
        p = F.col(f"_p_{w}")
        flags.append(F.when(early, f"window_{w}_predates_topen").when(p.isNull(), f"price_history_gap_window_{w}"))
        windows.append(F.when(~gap & ~early & (F.abs(one - p) >= eps), decimal_ratio(p_ref - p, one - p))
                       .alias(f"ils_{w}"))
    status = (F.when(p_open.isNull(), "price_gap_topen").when(p_ref.isNull(), "price_gap_tref").otherwise("ok"))
    gap_flags = F.array_compact(F.array(F.when(p_open.isNull(), "price_history_gap_at_topen")
                                        .otherwise("price_history_gap_at_tref")))
    keep = [c for c in refs.columns if c != "lead_flags"]
    return df.select(
        *keep, F.col("source").alias("price_source"), status.alias("status"),
        p_open.alias("p_open"), p_ref.alias("p_ref"),
        F.when(~gap, p_ref - p_open).alias("delta_pre"), F.when(~gap, total).alias("delta_total"),
        F.when(~gap & (F.abs(total) >= eps), decimal_ratio(p_ref - p_open, total)).alias("ils"), *windows,
        F.when(gap, F.when(p_open.isNull(), gap_flags).otherwise(F.concat("lead_flags", gap_flags)))
        .otherwise(F.concat("lead_flags", F.array_compact(F.array(*flags)))).alias("flags"))


def _history(prices: DataFrame, trades: DataFrame, price_source: str, history: History | None) -> tuple[History, DataFrame]:
    return (history, history_bounds(history, price_source)) if history else prepare_series(prices, trades, price_source)


def market_labels(markets: DataFrame, prices: DataFrame, trades: DataFrame, news: DataFrame,
                  price_source: str = "auto", history: History | None = None) -> DataFrame:
    """The full label row of every scorable market with prices.

    Deadline markets use the recovered event when they resolved to yes, and a one-hour lookback
    otherwise; all other markets need a news time. ``history`` is a stored one of these prices and trades; without it one is stored.
    """
    series, bounds = _history(prices, trades, price_source, history)
    best = staged(best_news(news).select("market_id", "t_news", "tier", "confidence"))
    m = staged(scorable(markets).select("market_id", "t_open", "t_resolve", "outcome", "category", "resolution_type")
               .join(bounds.select("market_id"), "market_id", "left_semi"))
    dl = m.where("resolution_type = 'deadline_resolved'")
    events = best.join(dl.where("outcome = 1").select("market_id"), "market_id", "left_semi") \
        .withColumnRenamed("t_news", "t_event")
    dl_refs = _deadline_after_snap(dl, events, bounds)
    other = m.where("resolution_type is null or resolution_type <> 'deadline_resolved'")
    std = snap_open(standard_refs(other, best), bounds).withColumn("t_news", F.col("t_ref"))
    refs = staged(dl_refs.unionByName(std.select(*dl_refs.columns)))
    scores = _score(refs, series, bounds)
    feats = refs.select("market_id", "t_news", "t_resolve", "p_resolve")
    return (scores.join(label_features(trades, feats), "market_id", "left")
            .join(m.select("market_id", "category", "resolution_type"), "market_id")
            .join(best.join(dl.where("outcome = 0").select("market_id"), "market_id", "left_anti")
                  .select("market_id", F.col("tier").alias("t_news_tier")), "market_id", "left"))


def _deadline_after_snap(markets: DataFrame, events: DataFrame, bounds: DataFrame) -> DataFrame:
    snapped = snap_open(markets.select("market_id", "t_open", "t_resolve", "outcome"), bounds)
    refs = deadline_refs(snapped, events).join(snapped.select("market_id", "t_open_snapped"), "market_id")
    lookback = F.col("t_resolve") - F.expr(f"interval {DEADLINE_LOOKBACK_HOURS} hours")
    return (refs.join(events.select("market_id", "t_event"), "market_id", "left")
            .withColumn("t_news", F.coalesce("t_event", lookback)).drop("t_event"))


def label_audit(labels: DataFrame) -> DataFrame:
    """Provenance row per label: score, flags, type and tier as one JSON text."""
    return labels.select("market_id", F.lit("label_computed").alias("event_type"), F.to_json(F.struct(
        F.col("ils").cast("string").alias("ils"), F.col("flags"), F.col("resolution_type"), F.col("t_news_tier")),
        {"ignoreNullFields": "false"}).alias("details"))


def score_candidates(markets: DataFrame, prices: DataFrame, news: DataFrame, labels: DataFrame,
                     limit: int | None = None) -> DataFrame:
    """Unlabelled markets ready to score: resolved deadline markets with prices first, then any with news.

    Markets are joined once, with what is known of each id from prices and news together.
    """
    known = (prices.select("market_id", F.lit(True).alias("priced"), F.lit(False).alias("told"))
             .unionByName(news.select("market_id", F.lit(False).alias("priced"), F.lit(True).alias("told")))
             .groupBy("market_id").agg(F.max("priced").alias("priced"), F.max("told").alias("told")))
    pool = F.when((F.col("resolution_type") == "deadline_resolved") & F.col("priced"), 1).when(F.col("told"), 2)
    out = (scorable(markets).join(labels.select("market_id"), "market_id", "left_anti").join(known, "market_id")
           .select("market_id", pool.alias("pool")).where("pool is not null").groupBy("market_id").agg(F.min("pool").alias("pool")))
    return out.orderBy("pool", "market_id").limit(limit) if limit else out


def offset_sweep(markets: DataFrame, prices: DataFrame, trades: DataFrame,
                 offset_hours: tuple[int, ...] = (24, 6, 2, 1), history: History | None = None) -> DataFrame:
    """Score at several fixed times before resolution; NULL where that is before the opening."""
    series, bounds = _history(prices, trades, "auto", history)
    base = staged(snap_open(scorable(markets).select("market_id", "t_open", "t_resolve",
                                                     F.col("outcome").alias("p_resolve")), bounds))
    sweep = (base.withColumn("offset_hours", F.explode(F.array(*[F.lit(h) for h in offset_hours])))
             .withColumn("t_ref", F.timestamp_micros(F.unix_micros("t_resolve")
                                                     - F.col("offset_hours") * F.lit(3_600_000_000))))
    asked = (base.select("market_id", F.lit("open").alias("kind"), F.col("t_open").alias("t"),
                         F.lit(True).alias("forward"))
             .unionByName(sweep.where("t_ref >= t_open")
                          .select("market_id", F.col("offset_hours").cast("string").alias("kind"),
                                  F.col("t_ref").alias("t"), F.lit(False).alias("forward"))))
    found = lookup_prices(asked, series, bounds)
    p_open = found.where("kind = 'open'").select("market_id", F.col("mid_price").alias("p_open"))
    p_ref = found.where("kind <> 'open'").select("market_id", F.col("kind").try_cast("int").alias("offset_hours"),
                                                 F.col("mid_price").alias("p_ref"))
    j = sweep.join(p_open, "market_id").join(p_ref, ["market_id", "offset_hours"], "left")
    total = F.col("p_resolve").cast(PRICE) - F.col("p_open")
    big = F.abs(total) >= F.lit(str(EPSILON)).cast(PRICE)
    return j.select("market_id", "offset_hours", "p_open", "p_ref",
                    F.when(big, decimal_ratio(F.col("p_ref") - F.col("p_open"), total)).alias("ils"))


def reference_compare(markets: DataFrame, prices: DataFrame, trades: DataFrame, first: DataFrame,
                      second: DataFrame, history: History | None = None) -> DataFrame:
    """Scores at two candidate news times (market_id, t_news) and their difference."""
    series, bounds = _history(prices, trades, "auto", history)
    m = staged(scorable(markets).select("market_id", "t_open", "t_resolve", F.col("outcome").alias("p_resolve"))
               .join(bounds.select("market_id"), "market_id", "left_semi"))

    def at(cand: DataFrame, tag: str) -> DataFrame:
        refs = snap_open(m.join(cand.select("market_id", F.col("t_news").alias("t_ref")), "market_id")
                         .withColumn("lead_flags", _no_flags()), bounds)
        return score(refs, series, bounds).select("market_id", F.col("ils").alias(f"ils_{tag}"),
                                                  F.col("t_ref").alias(f"t_{tag}"))

    return (at(first, "proxy").join(at(second, "report"), "market_id")
            .withColumn("delta", F.col("ils_report") - F.col("ils_proxy")))


def timing_label(first_trade: Column, t_proxy: Column, t_report: Column) -> Column:
    """Was the wallet early against both candidate times, one of them, or neither?"""
    return (F.when((first_trade < t_proxy) & (first_trade < t_report), "PRE_BOTH")
            .when(first_trade < t_proxy, "PRE_PROXY_ONLY").otherwise("POST_BOTH"))

"""Coverage and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.parsing import field, payload
from tidemark.operators.features import aligned_wallets, top_n
from tidemark.operators.ranks import percentiles
from tidemark.session import staged


def counts_by(df: DataFrame, key: Column, name: str, label_null: str | None = None) -> DataFrame:
    """Rows per value with their share of all rows; the total is a scalar subquery, so no task sees all values."""
    k = F.coalesce(key, F.lit(label_null)) if label_null else key
    total = df.agg(F.count("*")).scalar()
    return (df.groupBy(k.alias(name)).agg(F.count("*").alias("n"))
            .withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 1)))


def per_market(facts: DataFrame, name: str) -> DataFrame:
    return facts.groupBy("market_id").agg(F.count("*").alias(name))


def one_row(*parts: DataFrame) -> DataFrame:
    """Lay one-row aggregates side by side."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return df.agg(*[F.max(c).alias(c) for c in df.columns])


def category_inventory(markets: DataFrame, prices: DataFrame, limit: int = 20) -> DataFrame:
    has = per_market(prices, "n_p")
    return (markets.select("market_id", "category", "t_resolve").join(has, "market_id", "left")
            .groupBy(F.coalesce("category", F.lit("(uncategorised)")).alias("category"))
            .agg(F.count("*").alias("n"), F.count("t_resolve").alias("n_resolved"), F.count("n_p").alias("n_with_prices"))
            .orderBy(F.desc("n"), "category").limit(limit))


def coverage_counts(markets: DataFrame, facts: DataFrame) -> DataFrame:
    """Total facts, markets with facts, and resolved markets with and without them."""
    n = per_market(facts, "n_facts")
    totals = n.agg(F.coalesce(F.sum("n_facts"), F.lit(0)).alias("total_facts"), F.count("*").alias("markets_with_facts"))
    res = (markets.where("t_resolve is not null").select("market_id").join(n, "market_id", "left")
           .agg(F.count("n_facts").alias("resolved_with"), F.count_if(F.col("n_facts").isNull()).alias("resolved_without")))
    return one_row(totals, res)


def depth_counts(prices: DataFrame, least: list[int]) -> DataFrame:
    n = per_market(prices, "n")
    return n.agg(*[F.count_if(F.col("n") >= k).alias(f"n_{k}") for k in least]).unpivot(
        [], [f"n_{k}" for k in least], "depth", "n_markets")


def coverage_target(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Target markets by depth of their quotes, from per-market counts so that nothing fans out."""
    j = targets.select("market_id").join(per_market(prices, "n"), "market_id", "left")
    pick = lambda k: F.count_distinct(F.when(F.col("n") >= k, F.col("market_id")))
    return j.agg(F.count_distinct("market_id").alias("target_markets"), pick(1).alias("with_any"),
                 pick(C.MIN_PRICE_POINTS).alias("with_60plus"), pick(C.FULL_DAY_POINTS).alias("with_1day_plus"))


def exclusive_groups(markets: DataFrame, trades: DataFrame, resolved_after: Column,
                     min_volume: float = C.MIN_VOLUME) -> DataFrame:
    """Resolved, traded markets with a flag for one-of-many groups.

    A group counts when it is not marked exclusive already, has at least three markets and exactly
    one of them resolved to yes.
    """
    m = (markets.where((F.col("t_resolve") >= resolved_after) & F.col("outcome").isin(0, 1)
                       & (F.col("volume") >= min_volume))
         .join(trades.select("market_id").distinct(), "market_id", "left_semi"))
    groups = (m.where(~F.coalesce("neg_risk", F.lit(False))).groupBy("event_group")
              .agg(F.count("*").alias("n"), F.sum("outcome").alias("yes")).where("n >= 3 and yes = 1")
              .select("event_group", F.lit(True).alias("_g")))
    return m.join(groups, "event_group", "left").withColumn(
        "is_bucket_market", F.coalesce("neg_risk", F.lit(False)) | F.coalesce("_g", F.lit(False))).drop("_g")


def flag_counts(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def tier_coverage(news: DataFrame) -> DataFrame:
    return news.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))


def coverage_funnel(markets: DataFrame, news: DataFrame, labels: DataFrame) -> DataFrame:
    """Ordered stages from resolved markets to scores, each with the drop from the stage before."""
    stages = [markets.agg(F.count("t_resolve").alias("n")), news.agg(F.count("*").alias("n")),
              labels.agg(F.count("*").alias("n")), labels.agg(F.count("ils").alias("n"))]
    names = ["resolved_total", "got_tnews", "got_label_row", "got_ils"]
    df = None
    for i, (s, name) in enumerate(zip(stages, names)):
        row = s.select(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), "n")
        df = row if df is None else df.unionByName(row)
    return with_drops(df)


def with_drops(stages: DataFrame) -> DataFrame:
    w = Window.orderBy("step")  # a handful of stage rows
    return stages.withColumn("dropped", F.coalesce(F.lag("n").over(w) - F.col("n"), F.lit(0)))


def filter_attrition(population: DataFrame, order: list[str]) -> DataFrame:
    """Markets left after each exclusion reason in turn; every dropped row has a reason."""
    pos = F.array_position(F.array(*[F.lit(r) for r in order]), F.split("exclusion_reason", ":")[0])
    by = population.groupBy(pos.alias("pos")).agg(F.count("*").alias("n"))
    last = F.when(F.col("pos") > 0, F.col("pos") - 1).otherwise(F.lit(len(order)))
    every = population.sparkSession.range(len(order) + 1).select(F.col("id").alias("step"), F.lit(0).cast("long").alias("n"))
    left = (by.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select("step", "n")
            .unionByName(every).groupBy("step").agg(F.sum("n").alias("n")))
    names = F.array(F.lit("initial"), *[F.lit(f"after_{r}") for r in order])
    return with_drops(left.withColumn("stage", F.element_at(names, (F.col("step") + 1).cast("int"))))


def ils_by_category(labels: DataFrame) -> DataFrame:
    x = F.col("value").cast("double")
    p = percentiles(labels, ["category"], "ils", {"p25": 0.25, "median": 0.5, "p75": 0.75},
                    [F.min(x).alias("ils_min"), F.max(x).alias("ils_max")])
    other = (labels.where("ils is not null").groupBy(F.col("category").alias("c"))
             .agg(F.avg("volume_pre_share").alias("avg_vol_pre"), F.avg("wallet_hhi").alias("avg_hhi")))
    j = p.join(other, F.col("category").eqNullSafe(F.col("c"))).withColumnRenamed("total", "n_markets")
    rounded = ["ils_min", "p25", "median", "p75", "ils_max", "avg_vol_pre", "avg_hhi"]
    return j.select("category", "n_markets", *[F.round(c, 3).alias(c) for c in rounded]) \
        .orderBy(F.desc_nulls_last("median"), "category")


def domain(url: Column) -> Column:
    return F.regexp_extract(url, "https?://([^/]+)", 1)


def short_domain(url: Column) -> Column:
    """Second and third label of the host."""
    host = F.split_part(url, F.lit("/"), F.lit(3))
    return F.concat(F.split_part(host, F.lit("."), F.lit(2)), F.lit("."), F.split_part(host, F.lit("."), F.lit(3)))


def evidence_domains(markets: DataFrame, limit: int = 15) -> DataFrame:
    return (markets.where("evidence_url is not null").groupBy(domain(F.col("evidence_url")).alias("domain"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(limit))


def daily_price_path(prices: DataFrame) -> DataFrame:
    return (prices.groupBy("market_id", F.date_trunc("day", "ts").alias("day"))
            .agg(F.avg(F.col("mid_price").cast("double")).alias("avg_mid"), F.count("*").alias("n_points"))
            .withColumn("avg_inverted", F.lit(1.0) - F.col("avg_mid")))


def wallet_market_counts(trades: DataFrame) -> DataFrame:
    """Distinct markets ever traded per taker."""
    return trades.groupBy(F.col("taker_address").alias("address")).agg(F.count_distinct("market_id").alias("total_markets"))


def wallet_profile(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    agg = trades.groupBy(F.col("taker_address").alias("address")).agg(
        F.count("*").alias("n_trades"), F.sum("notional_usdc").alias("volume"), F.min("ts").alias("first_trade"))
    return agg.join(wallets.select("address", "first_seen_chain_at", "first_seen_venue_at"), "address", "left")


def ranked_wallets(trades: DataFrame, refs: DataFrame, wallets: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    """Largest or smallest aligned wallets per market before the news, with profile columns."""
    order = F.desc("notional") if largest else F.asc("notional")
    top = staged(top_n(aligned_wallets(trades, refs), ["market_id"], [order, "address"], n))
    theirs = trades.join(top.select(F.col("address").alias("taker_address")).distinct(), "taker_address", "left_semi")
    share = F.lit(100.0) * F.col("notional").cast("double") / F.sum(F.col("notional").cast("double")).over(
        Window.partitionBy("market_id"))  # at most n rows per market
    lead = (F.unix_micros("t_news") - F.unix_micros("first_trade_ts")) / 60_000_000
    return (top.withColumn("share_pct", share).withColumn("lead_minutes", F.round(lead, 1))
            .join(wallet_market_counts(theirs), "address", "left")
            .join(wallets.select("address", "first_seen_chain_at", "first_seen_venue_at"), "address", "left"))


def cross_market_wallets(trades: DataFrame, market_set: DataFrame, least: int = 2) -> DataFrame:
    """Takers active in several markets of a set.

    The id list is built from distinct (wallet, market) pairs; its length is a number of markets.
    """
    pairs = (trades.join(market_set.select("market_id"), "market_id", "left_semi")
             .groupBy(F.col("taker_address").alias("address"), "market_id")
             .agg(F.sum("notional_usdc").alias("v"), F.min("ts").alias("t")))
    several = staged(pairs.groupBy("address").agg(F.count("*").alias("n_markets"), F.sum("v").alias("volume"), F.min("t").alias("earliest_trade"),
                                                  F.sort_array(F.collect_list("market_id")).alias("market_ids")).where(F.col("n_markets") >= least))
    theirs = trades.join(several.select(F.col("address").alias("taker_address")), "taker_address", "left_semi")
    return several.join(wallet_market_counts(theirs), "address", "left")


def market_trade_stats(trades: DataFrame, limit: int | None = 20) -> DataFrame:
    df = trades.groupBy("market_id").agg(
        F.count("*").alias("n_trades"), F.min("ts").alias("first_trade"), F.max("ts").alias("last_trade"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.avg(F.col("price").cast("double")).alias("avg_price"), F.count_if(F.col("price") > 0).alias("n_valid"))
    return df.orderBy(F.desc("n_trades"), "market_id").limit(limit) if limit else df


def run_stats(runs: DataFrame) -> DataFrame:
    """Ledger summary per collector and status."""
    return runs.groupBy("collector", "status").agg(
        F.count("*").alias("runs"), F.avg("n_records").alias("avg_records"), F.sum("n_records").alias("total_records"),
        F.count_distinct("target").alias("targets"), F.count_if(F.col("n_records") == 0).alias("zero_runs"))


def reruns(runs: DataFrame, limit: int = 10) -> DataFrame:
    return (runs.where("status = 'success'").groupBy("target")
            .agg(F.count("*").alias("runs"), F.sum("n_records").alias("total_written"))
            .orderBy(F.desc("runs"), "target").limit(limit))


def latest_runs(runs: DataFrame, key: str, n: int = 1) -> DataFrame:
    """Last n runs per collector or target."""
    return top_n(runs, [key], [F.desc("started_at"), F.desc("run_id")], n)


def freshness_buckets(markets: DataFrame, as_of: Column) -> DataFrame:
    age = lambda d: F.col("last_refreshed_at") > as_of - F.expr(f"interval {d} days")
    bucket = F.when(age(1), "<1d").when(age(7), "1-7d").when(age(30), "7-30d").otherwise(">30d")
    return (markets.groupBy(bucket.alias("bucket"))
            .agg(F.count("*").alias("n"), F.min("last_refreshed_at").alias("oldest")).orderBy(F.desc("oldest")))


def tag_counts(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Tags of JSON market lines, with a count among geopolitical markets; non-arrays have no tags."""
    tags = F.from_json(F.get_json_object("line", "$.tags"), "array<string>")
    df = (raw.select(F.explode(tags).alias("tag"), "category").groupBy("tag")
          .agg(F.count("*").alias("n"), F.count_if(F.col("category") == "military_geopolitics").alias("geopolitical")))
    return df.orderBy(F.desc("n"), "tag").limit(limit) if limit else df


def json_field_audit(raw: DataFrame) -> DataFrame:
    """Where does the resolve time of a market come from? Needs line and t_resolve; a line is parsed once, a broken one has no field."""
    p = raw.select("t_resolve", payload(F.col("line")).alias("p"))
    closed, resolved = field("p", "$.closedTime").isNotNull(), F.col("t_resolve").isNotNull()
    return p.agg(
        F.count_if(resolved).alias("resolved_total"), F.count_if(resolved & closed).alias("resolved_with_closed_time"),
        F.count_if(resolved & ~closed).alias("resolved_no_closed_time"),
        F.count_if(~resolved & closed).alias("unresolved_with_closed_time"), F.count_if(closed).alias("with_closed_time"),
        F.count_if(field("p", "$.startDate").isNotNull()).alias("with_start_date"),
        F.count_if(field("p", "$.events[0].negRisk") == "true").alias("exclusive_events"))


def label_health(labels: DataFrame) -> DataFrame:
    return labels.groupBy("p_resolve").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count("ils") / F.count("*"), 1).alias("pct_defined"),
        F.count_if(F.col("ils").isNull()).alias("n_null"),
        F.count_if(F.array_contains("flags", "low_information_market")).alias("n_low_information"),
        F.min("ils").alias("ils_min"), F.max("ils").alias("ils_max"))


def lifecycle_coverage(markets: DataFrame, prices: DataFrame) -> DataFrame:
    """Do the quotes of a market span its whole life?"""
    p = prices.groupBy("market_id").agg(F.count("*").alias("n_prices"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    j = markets.select("market_id", "t_open", "t_resolve").join(p, "market_id", "left").fillna(0, ["n_prices"])
    known = F.col("t_open").isNotNull() & F.col("t_resolve").isNotNull()
    full = (F.col("min_ts") <= F.col("t_open")) & (F.col("max_ts") >= F.col("t_resolve"))
    return j.withColumn("coverage", F.when(F.col("n_prices") == 0, "none").when(~known, "incomplete")
                        .when(full, "full").otherwise("partial"))


def data_gap_hypotheses(markets: DataFrame, trades: DataFrame, prices: DataFrame, news: DataFrame,
                        wallets: DataFrame, as_of: Column) -> DataFrame:
    """Five yes/no checks on what is missing, from one-row aggregates."""
    m = markets.agg(F.count("t_resolve").alias("resolved"), F.count("*").alias("total"),
                    F.count_if(F.col("category").isin(C.POLITICAL_CATEGORIES)).alias("political"))
    t = coverage_counts(markets, trades).select(F.col("resolved_with").alias("rt"), F.col("resolved_without").alias("rn"))
    p = coverage_counts(markets, prices).select(F.col("resolved_with").alias("rp"))
    no_news = (markets.where("t_resolve is not null and evidence_url is not null").join(news.select("market_id"), "market_id", "left_anti")
               .agg(F.count("*").alias("evidence_no_news")))
    n = news.agg(F.count("*").alias("total_news"))
    stale = (F.col("last_refreshed_at") < as_of - F.expr("interval 30 days")) | F.col("first_seen_chain_at").isNull()
    w = wallets.agg(F.count("*").alias("total_wallets"), F.count("first_seen_chain_at").alias("chain"), F.count_if(stale).alias("stale"))
    one = one_row(m, t, p, no_news, n, w)
    return one.select(
        (F.col("political") < F.greatest(F.lit(50.0), F.col("resolved") * 0.15)).alias("h1"),
        ((F.col("rt") == 0) | (F.col("rn") > F.col("resolved") * 0.5)).alias("h2"),
        ((F.col("stale") > F.col("total_wallets") * 0.8) | (F.col("chain") == 0)).alias("h3"),
        (F.col("evidence_no_news") > 0).alias("h4"), ((F.col("rp") > 0) & (F.col("total_news") == 0)).alias("h5"))


def collection_diagnosis(markets: DataFrame, trades: DataFrame, runs: DataFrame) -> DataFrame:
    """Why does a market lack trades, and what should be tried next?"""
    r = runs.groupBy(F.col("target").alias("market_id")).agg(
        F.count("*").alias("n_runs"), F.max_by("n_records", F.struct("started_at", "run_id")).alias("last_written"),
        F.bool_or(F.col("status") == "success").alias("ok"), F.bool_or(F.col("status") == "failed").alias("bad"))
    j = (markets.select("market_id", "volume").join(per_market(trades, "n"), "market_id", "left")
         .join(r, "market_id", "left").fillna(0, ["n", "n_runs", "last_written"]))
    n, vol = F.col("n"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0))
    rules = [
        ((F.col("n_runs") == 0) & (n > 0), "partial", "rerun"),
        (F.col("n_runs") == 0, "never_run", "rerun"),
        ((n == 0) & F.col("ok") & (F.col("last_written") == 0) & (vol >= C.INDEXER_VOLUME_ZERO), "ran_indexer_failed", "direct_logs"),
        ((n == 0) & F.col("ok") & (F.col("last_written") == 0), "ran_returned_zero", "rerun"),
        ((n == 0) & F.col("bad") & (vol >= C.INDEXER_VOLUME_FAILED), "ran_indexer_failed", "direct_logs"),
        ((n == 0) & F.col("bad"), "ran_indexer_failed", "rerun"),
        ((n > 0) & (n < 100), "partial", "rerun"),
        (n >= 100, "ok", "ok")]
    diag = rec = None
    for cond, d, a in rules:
        diag = F.when(cond, d) if diag is None else diag.when(cond, d)
        rec = F.when(cond, a) if rec is None else rec.when(cond, a)
    return j.select("market_id", n.alias("n_trades"), "n_runs", diag.otherwise("investigate_further").alias("diagnosis"),
                    rec.otherwise("investigate_further").alias("recommendation"))


def validity_gates(markets: DataFrame, news: DataFrame, labels: DataFrame, case_cond: Column) -> DataFrame:
    """Acceptance gates on the funnel and a traffic light from the number of failed ones."""
    m = markets.agg(F.count("t_resolve").alias("resolved"))
    t1 = news.agg(F.count_if(F.col("tier") == 1).alias("tier1"))
    l = labels.agg(F.count("ils").alias("got"), F.count_if(F.array_contains("flags", "low_information_market")).alias("low"),
                   F.count_if(case_cond & (F.col("ils") >= 0.5)).alias("cases"))
    med = percentiles(labels.where(F.col("category").isin("military_geopolitics", "other")), ["category"], "ils", {"median": 0.5}) \
        .agg(F.max(F.when(F.col("category") == "military_geopolitics", F.col("median"))).alias("geo"),
             F.max(F.when(F.col("category") == "other", F.col("median"))).alias("oth"))
    j = one_row(m, t1, l, med)
    got, res = F.col("got"), F.greatest(F.col("resolved"), F.lit(1))
    gates = j.select(
        (100.0 * F.col("tier1") / res >= 20).alias("tier1_ok"), (100.0 * got / res >= 70).alias("coverage_ok"),
        F.coalesce(F.col("geo") - F.col("oth") >= 0.15, F.lit(False)).alias("separation_ok"),
        (F.col("cases") >= 2).alias("cases_ok"),
        F.coalesce(F.try_divide(100.0 * F.col("low"), got) < 30, F.lit(True)).alias("low_information_ok"))
    red = sum((~F.col(c)).cast("int") for c in gates.columns)
    return gates.withColumn("light", F.when(red == 0, "GREEN").when(red <= 2, "YELLOW").otherwise("RED"))


def case_status_rollup(rows: DataFrame) -> DataFrame:
    """Totals and status counts per case from per-market collection rows."""
    return rows.groupBy("case_id", "status").agg(
        F.count("*").alias("n"), F.sum(F.col("before") + F.col("written")).alias("total"))


def recovery_cost_stats(answers: DataFrame) -> DataFrame:
    """Recovered share and cost per model, with the gate of at least 70 % recovered."""
    return answers.groupBy("model").agg(
        F.count("*").alias("n"), F.count("t_event").alias("n_recovered"), F.sum("cost").alias("total_cost"),
        F.avg("cost").alias("cost_per_answer"),
        (F.count("t_event") >= 0.7 * F.count("*")).alias("passes"))


def histogram(df: DataFrame, groups: list[str], value: str, edges: list[float]) -> DataFrame:
    """Counts per group between fixed edges, open at both ends, zero where empty."""
    x = F.col(value).cast("double")
    b = sum((x >= e).cast("int") for e in edges)
    n = df.where(x.isNotNull()).groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"))
    return zero_filled(n, groups, len(edges) + 1)


def even_histogram(df: DataFrame, groups: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins; values outside fall in the first or last one."""
    x = F.col(value).cast("double")
    q = (x - lo) / ((hi - lo) / bins)
    cut = F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), cut)).cast("int")
    n = df.where(x.isNotNull()).groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"))
    return zero_filled(n, groups, bins)


def zero_filled(counts: DataFrame, groups: list[str], bins: int) -> DataFrame:
    grid = counts.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*groups, "bin"], "left").fillna(0, ["n"])


def calibration(df: DataFrame, price: str, outcome: str) -> DataFrame:
    """Reliability bins of a forecast with the overall Brier score repeated on each."""
    p, o = F.col(price).cast("double"), F.col(outcome).cast("double")
    binned = df.where(p.isNotNull() & o.isNotNull()).groupBy(F.least(F.floor(p * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(o).alias("yes_rate"), F.sum((p - o) * (p - o)).alias("_s"))
    all_bins = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ten rows
    return (binned.withColumn("brier", F.sum("_s").over(all_bins) / F.sum("n").over(all_bins))
            .withColumn("miscalibrated", (F.col("n") >= 5) & (F.abs(F.col("mean_p") - F.col("yes_rate")) > 0.4)).drop("_s"))


def proxy_summary(scores: DataFrame) -> DataFrame:
    """Distribution of scores per offset."""
    x, n = F.col("value").cast("double"), F.col("n")
    p = percentiles(scores, ["offset_hours"], "ils", {"median": 0.5}, [
        (F.sum(x * n) / F.sum(n)).alias("mean"), (100.0 * F.sum(F.when(x > 0, n).otherwise(0)) / F.sum(n)).alias("pct_pos"),
        (100.0 * F.sum(F.when(F.abs(x) > 1, n).otherwise(0)) / F.sum(n)).alias("pct_extreme")])
    return p.withColumnRenamed("total", "n")


def monotone_trend(scores: DataFrame, offsets: list[int]) -> DataFrame:
    """Markets whose score never falls, or never rises, as the offset shrinks."""
    cols = [F.max(F.when(F.col("offset_hours") == h, F.col("ils").cast("double"))).alias(f"o{h}") for h in offsets]
    wide = scores.groupBy("market_id").agg(*cols).dropna()
    up = down = F.lit(True)
    for a, b in zip(offsets, offsets[1:]):
        up, down = up & (F.col(f"o{a}") <= F.col(f"o{b}")), down & (F.col(f"o{a}") >= F.col(f"o{b}"))
    return wide.agg(F.count("*").alias("n_aligned"), F.count_if(up).alias("n_increasing"), F.count_if(down).alias("n_decreasing"))


def date_disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two recovered dates; NULL where a side is missing, severity only for different dates."""
    d = F.abs(F.datediff(F.col(a), F.col(b)))
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return (df.withColumn("exact_match", F.when(known, d == 0)).withColumn("within_24h", F.when(known, d <= 1))
            .withColumn("within_6h", F.when(known, d == 0)).withColumn("delta_days", F.when(known, d))
            .withColumn("severity", F.when(known & (d > 0), F.when(d <= 7, "minor").otherwise("major"))))


def agreement_rates(df: DataFrame, bucket: str) -> DataFrame:
    """Share of agreeing rows overall and per bucket; missing comparisons are left out of the shares."""
    both = df.withColumn("_g", F.explode(F.array(F.lit("overall"), F.coalesce(bucket, F.lit("none")))))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate")
    return both.groupBy(F.col("_g").alias("scope")).agg(
        F.count("*").alias("n"), rate("exact_match"), rate("within_24h"), rate("within_6h"), rate("source_overlap"),
        F.count_if(F.col("severity") == "minor").alias("n_minor"), F.count_if(F.col("severity") == "major").alias("n_major"))


def sources_overlap(a: Column, b: Column) -> Column:
    """Any common URL; false when either list is empty or missing."""
    empty = F.array().cast("array<string>")
    return F.arrays_overlap(F.array_compact(F.coalesce(a, empty)), F.array_compact(F.coalesce(b, empty)))


def group_comparison(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    x, n = F.col("value").cast("double"), F.col("n")
    p = percentiles(df, groups, value, {"median": 0.5}, [
        (F.sum(x * n) / F.sum(n)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        (100.0 * F.sum(F.when(x > 0, n).otherwise(0)) / F.sum(n)).alias("pct_pos")])
    return p.withColumnRenamed("total", "n")


def comparison_verdict(p_value: Column, ci_low: Column, ci_high: Column) -> Column:
    return (F.when((p_value < 0.05) & (ci_low > 0), "SEPARATION").when((p_value < 0.05) & (ci_high < 0), "REVERSED_SEPARATION")
            .when(p_value < 0.1, "MARGINAL").otherwise("NO_SEPARATION"))

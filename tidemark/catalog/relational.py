"""Selections, joins, audits, sorts and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.catalog.registry import query
from tidemark.catalog.sqlparts import SERIES, WALLETS
from tidemark.operators import audits as au
from tidemark.operators import features as feat
from tidemark.operators import filters as fi
from tidemark.operators.distinct import distinct_counts
from tidemark.operators.ranks import ranked_values, value_at_rank
from tidemark.plans import scoring as plan
from tidemark.sources.upsert import keep_first, upsert

AS_OF = "timestamp '2024-02-01 00:00:00'"
_CATS = ", ".join(f"'{c}'" for c in C.TARGET_CATEGORIES)
_M = "market_id category resolution_type outcome:l volume:d"


# ---------------------------------------------------------------- selections
@query("scorable_markets", _M, "select * from markets where outcome is not null and t_open is not null and t_resolve is not null")
def scorable_markets(v):
    return plan.scorable(v.markets)


@query("target_universe", _M, f"select * from markets where category in ({_CATS}) and volume >= 50000 and t_resolve is not null")
def target_universe(v):
    return fi.target_universe(v.markets)


@query("prefilter_scope", _M + " in_scope:b exclusion_reason", """
    select *, not coalesce(resolution_type = 'deadline_resolved' and outcome = 0, false) as in_scope,
      case when resolution_type = 'deadline_resolved' and outcome = 0 then 'deadline_NO' else '' end as exclusion_reason
    from markets where t_resolve is not null and resolution_type <> 'unclassifiable'""")
def prefilter_scope(v):
    return fi.prefilter_scope(v.markets)


@query("stale_wallets", "address", f"""
    select address from wallets where last_refreshed_at < {AS_OF} - interval 20 day or first_seen_chain_at is null""")
def stale_wallets(v):
    return fi.stale_wallets(v.wallets, F.expr(AS_OF), 20)


@query("needs_collection", "market_id n_trades:l n_prices:l fetch_trades:b fetch_quotes:b", f"""
    with t as (select market_id, count(*) n from trades group by all), p as (select market_id, count(*) n from prices group by all)
    select m.market_id, coalesce(t.n, 0) as n_trades, coalesce(p.n, 0) as n_prices,
      not (coalesce(t.n, 0) > 0 and coalesce({AS_OF} - interval 24 hour > m.t_resolve, false)) as fetch_trades,
      not (coalesce(t.n, 0) > 0 and coalesce({AS_OF} - interval 24 hour > m.t_resolve, false)) and coalesce(p.n, 0) < 60 as fetch_quotes
    from markets m left join t on t.market_id = m.market_id left join p on p.market_id = m.market_id""")
def needs_collection(v):
    return fi.needs_collection(v.markets, v.trades, v.prices, F.expr(AS_OF))


@query("unresolved_markets", "market_id", "select market_id from markets where t_resolve is null")
def unresolved_markets(v):
    return v.markets.where("t_resolve is null")


@query("evidence_candidates", _M, """select * from markets where resolution_type = 'event_resolved' and evidence_url is null
    and volume >= 50000""")
def evidence_candidates(v):
    return fi.evidence_candidates(v.markets)


@query("unclassified_markets", "market_id question", "select market_id, question from markets where category is null")
def unclassified_markets(v):
    return fi.unclassified(v.markets, "category")


@query("suggest_validation_set", "market_id question category outcome:l",
       "select * from markets where outcome is not null and (" +
       " or ".join(f"question ilike '%{w}%'" for w in C.SIGNAL_KEYWORDS) + ")")
def suggest_validation_set(v):
    return fi.suggest_validation_set(v.markets)


@query("keyword_case_filter", "market_id question category ils:d tier:l confidence:d", f"""
    select m.market_id, m.question, m.category, l.ils, n.tier, n.confidence from scored l
    join markets m on m.market_id = l.market_id join news n on n.market_id = l.market_id
    where regexp_matches(lower(m.question), '{C.CASE_PATTERN}')
    order by l.ils desc nulls last, m.market_id, n.tier limit 20""")
def keyword_case_filter(v):
    j = (v.markets.where(F.lower("question").rlike(C.CASE_PATTERN)).select("market_id", "question", "category")
         .join(v.scored.select("market_id", "ils"), "market_id").join(v.news.select("market_id", "tier", "confidence"), "market_id"))
    return j.orderBy(F.desc_nulls_last("ils"), "market_id", "tier").limit(20)


@query("url_allowed", "page_id:l url allowed:b", f"""
    select page_id, url, regexp_matches(lower(url), '^https?:') and not regexp_matches(url, '{C.DENIED_HOSTS}') as allowed from pages""")
def url_allowed(v):
    return v.pages.withColumn("allowed", fi.url_allowed(F.col("url")))


@query("prefix_lookup", "prefix market_id", """
    with p as (select distinct substring(market_id, 1, 10) as prefix from trades)
    select p.prefix, min(m.market_id) as market_id from p left join markets m on starts_with(m.market_id, p.prefix) group by p.prefix""")
def prefix_lookup(v):
    p = v.trades.select(F.substring("market_id", 1, 10).alias("prefix")).distinct()
    m = v.markets.groupBy(F.substring("market_id", 1, 10).alias("prefix")).agg(F.min("market_id").alias("market_id"))
    return p.join(m, "prefix", "left")


@query("random_sample", "market_id", f"""
    select market_id from markets order by md5('{C.SEED}|' || market_id), market_id limit 50""")
def random_sample(v):
    return fi.random_sample(v.markets.select("market_id"), "market_id", 50)


@query("period_bucket", "market_id period bucket", """
    select market_id, case when cast(t_resolve as date) < date '2024-11-01' then 'pre_2024' else 'post_2024' end as period,
      case when coalesce(subcategory, '') like '%announcement%' then 'regulatory_announcement'
           when coalesce(subcategory, '') like '%formal%' then 'regulatory_formal' else 'other' end as bucket from population""")
def period_bucket(v):
    return v.population.select("market_id", fi.period_bucket(F.col("t_resolve")).alias("period"),
                               fi.study_bucket(F.col("subcategory")).alias("bucket"))


@query("quality_asserts", "rule violations:l", """
    select 'ils_range' as rule, count(*) filter (not coalesce(ils between -1 and 2, false)) as violations from scored
    union all select 'after_cutoff', count(*) filter (not coalesce(computed_at >= timestamp '1996-01-01', false)) from scored
    union all select 'volume_positive', count(*) filter (not coalesce(volume > 0, false)) from scored""")
def quality_asserts(v):
    return fi.violations(v.scored, {"ils_range": F.col("ils").between(-1, 2),
                                    "after_cutoff": F.col("computed_at") >= F.expr("timestamp '1996-01-01'"),
                                    "volume_positive": F.col("volume") > 0})


@query("event_yes_markets", "market_id", """
    select market_id from markets m where resolution_type = 'deadline_resolved' and outcome = 1 and t_open is not null
      and t_resolve is not null and not exists (select 1 from news n where n.market_id = m.market_id and n.tier = 1 or
        n.market_id = m.market_id and n.tier = 2)""")
def event_yes_markets(v):
    return plan.scorable(v.markets).where("resolution_type = 'deadline_resolved' and outcome = 1") \
        .join(v.news.where("tier in (1, 2)").select("market_id"), "market_id", "left_anti")


@query("recovery_route", "market_id route", """
    select market_id, case when resolution_type = 'deadline_resolved' and coalesce(outcome, 0) <> 1 then 'skip'
      when resolution_type = 'deadline_resolved' then 't_event' else 't_news' end as route from markets""")
def recovery_route(v):
    return fi.recovery_route(v.markets)


@query("since_filter", "market_id t_open:t", """
    select market_id, t_open from markets where t_open >= timestamp '1998-01-01' and end_date >= timestamp '1998-03-01'
      and end_date < timestamp '2000-01-01'""")
def since_filter(v):
    return v.markets.where("t_open >= timestamp '1998-01-01' and end_date >= timestamp '1998-03-01' and end_date < timestamp '2000-01-01'")


@query("noted_markets", "market_id", "select distinct market_id from news where notes like 'proxy:%'")
def noted_markets(v):
    return v.news.where(F.col("notes").startswith("proxy:")).select("market_id").distinct()


@query("recovery_acceptance", "status n:l", """
    select case when n.t_news is null then 'none' when n.confidence < 0.70 then 'low_confidence'
      when n.t_news <= m.t_open then 'negative_tau' else 'accepted' end as status, count(*) as n
    from markets m left join news n on n.market_id = m.market_id and n.tier = 3 group by all""")
def recovery_acceptance(v):
    j = v.markets.select("market_id", "t_open").join(
        v.news.where("tier = 3").select("market_id", F.col("t_news").alias("t_event"), "confidence"), "market_id", "left")
    return j.groupBy(fi.recovery_status(j).alias("status")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- joins
@query("trade_counts_left", "market_id n_trades:l", """
    select m.market_id, count(t.tx_hash) as n_trades from markets m left join trades t on t.market_id = m.market_id group by all""")
def trade_counts_left(v):
    return v.markets.select("market_id").join(au.per_market(v.trades, "n_trades"), "market_id", "left").fillna(0, ["n_trades"])


def _exists(key, table, kind):
    anti = kind == "left_anti"
    sql = f"select market_id from markets m where {'not ' if anti else ''}exists (select 1 from {table} x where x.market_id = m.market_id)"

    @query(key, "market_id", sql)
    def run(v, table=table, kind=kind):
        # distinct ids: what is shuffled grows with the markets, not with the facts
        return v.markets.select("market_id").join(getattr(v, table).select("market_id").distinct(), "market_id", kind)


_exists("semi_has_prices", "prices", "left_semi")
_exists("semi_has_trades", "trades", "left_semi")
_exists("anti_unlabelled", "scored", "left_anti")
_exists("anti_no_news", "news", "left_anti")
_exists("anti_no_trades", "trades", "left_anti")
_exists("anti_no_prices", "prices", "left_anti")


@query("labels_markets_news", "market_id question ils:d tier:l t_news:t", """
    select m.market_id, m.question, l.ils, n.tier, n.t_news from scored l join markets m on m.market_id = l.market_id
    join news n on n.market_id = l.market_id""")
def labels_markets_news(v):
    return (v.scored.select("market_id", "ils").join(v.markets.select("market_id", "question"), "market_id")
            .join(v.news.select("market_id", "tier", "t_news"), "market_id"))


@query("wallet_profile_left", "address n_trades:l volume:d first_trade:t first_seen_chain_at:t first_seen_venue_at:t", """
    select t.taker_address as address, count(*) as n_trades, sum(t.notional_usdc) as volume, min(t.ts) as first_trade,
      any_value(w.first_seen_chain_at) as first_seen_chain_at, any_value(w.first_seen_venue_at) as first_seen_venue_at
    from trades t left join wallets w on w.address = t.taker_address group by t.taker_address""")
def wallet_profile_left(v):
    return au.wallet_profile(v.trades, v.wallets)


@query("wallet_total_markets", "address total_markets:l", """
    select taker_address as address, count(distinct market_id) as total_markets from trades group by all""")
def wallet_total_markets(v):
    return au.wallet_market_counts(v.trades)


@query("instrumented_markets", "market_id t_news:t ils:d", """
    select m.market_id, n.t_news, l.ils from markets m join news n on n.market_id = m.market_id and n.tier = 2
    left join scored l on l.market_id = m.market_id where exists (select 1 from prices p where p.market_id = m.market_id)""")
def instrumented_markets(v):
    return (v.markets.select("market_id").join(v.news.where("tier = 2").select("market_id", "t_news"), "market_id")
            .join(v.prices.select("market_id"), "market_id", "left_semi")
            .join(v.scored.select("market_id", "ils"), "market_id", "left"))


@query("coverage_target", "target_markets:l with_any:l with_60plus:l with_1day_plus:l", f"""
    with target as (select market_id from markets where category in ({_CATS}) and volume >= 5000 and t_resolve is not null),
    pc as (select market_id, count(*) as n from prices group by all)
    select count(distinct t.market_id) as target_markets, count(distinct pc.market_id) as with_any,
      count(distinct case when pc.n >= 60 then pc.market_id end) as with_60plus,
      count(distinct case when pc.n >= 1440 then pc.market_id end) as with_1day_plus
    from target t left join pc on pc.market_id = t.market_id""")
def coverage_target(v):
    return au.coverage_target(fi.target_universe(v.markets, 5000), v.prices)


@query("control_candidates", "market_id n_trades:l", f"""
    select m.market_id, count(*) as n_trades from markets m join trades t on t.market_id = m.market_id
    where m.resolution_type = 'unclassifiable' and m.volume >= 1000 and m.category in ({_CATS}) and m.t_resolve is not null
      and m.outcome is not null and not exists (select 1 from scored s where s.market_id = m.market_id)
      and not exists (select 1 from news n where n.market_id = m.market_id and n.notes = 'page date')
    group by m.market_id having count(*) >= 90""")
def control_candidates(v):
    return fi.control_candidates(v.markets, v.trades, v.scored, v.news.where("notes = 'page date'"), 90, 1000)


@query("resolve_by_embedded_id", "num:l market_id", """
    select r.num, m.market_id from requests r join markets m
      on m.market_id = regexp_extract(decode(unhex(r.ancillary_hex)), '0x[0-9a-f]{64}') where r.settled""")
def resolve_by_embedded_id(v):
    from tidemark.functions.parsing import embedded_ids, decode_hex_text
    text = F.lower(decode_hex_text(F.col("ancillary_hex")))
    ids = v.requests.where("settled").select("num", F.explode(embedded_ids(text)).alias("market_id")).distinct()
    return ids.join(v.markets.select("market_id"), "market_id", "left_semi")


@query("attach_flags_left", "market_id ils_dl:d anchor_robust:b", """
    select p.market_id, p.ils_dl, a.ok as anchor_robust from population p left join
      (select market_id, volume_pre_share > 0.5 as ok from scored where ils is not null) a on a.market_id = p.market_id""")
def attach_flags_left(v):
    a = v.scored.where("ils is not null").select("market_id", (F.col("volume_pre_share") > 0.5).alias("anchor_robust"))
    return v.population.join(a, "market_id", "left")


# -------------------------------------------------------------------- audits
@query("wallet_first_seen", "address first_seen:t", """
    select address, min(ts) as first_seen from (select taker_address as address, ts from trades
      union all select maker_address, ts from trades) group by all""")
def wallet_first_seen(v):
    return feat.wallet_first_seen(v.trades)


@query("wallet_first_seen_merge", "address first_seen:t", """
    with n as (select address, min(ts) as first_seen from (select taker_address as address, ts from trades
      union all select maker_address, ts from trades) group by all)
    select coalesce(n.address, w.address) as address, least(n.first_seen, w.first_seen_chain_at) as first_seen
    from n full join wallets w on w.address = n.address""")
def wallet_first_seen_merge(v):
    old = v.wallets.select("address", F.col("first_seen_chain_at").alias("first_seen"))
    return upsert(old, feat.wallet_first_seen(v.trades), ["address"], {"first_seen": "least"})


@query("funding_sources_top10", "address rank:l counterparty n_transfers:l total_usdc:d", """
    with s as (select lower(to_address) as address, lower(from_address) as counterparty, count(*) as n_transfers,
        sum(value_units::decimal(30,0) * 0.000001) as total_usdc from transfers group by all)
    select * from (select *, row_number() over (partition by address order by total_usdc desc, counterparty) as rank from s) where rank <= 10""")
def funding_sources_top10(v):
    return feat.funding_sources(v.transfers)


@query("typology_counts", "resolution_type n:l pct:d", """
    select coalesce(resolution_type, '(none)') as resolution_type, count(*) as n,
      round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from markets group by all""")
def typology_counts(v):
    return au.counts_by(v.markets, F.col("resolution_type"), "resolution_type", "(none)")


@query("category_inventory", "category n:l n_resolved:l n_with_prices:l", """
    select coalesce(category, '(uncategorised)') as category, count(*) as n, count(t_resolve) as n_resolved,
      count(p.market_id) as n_with_prices from markets m left join (select distinct market_id from prices) p
      on p.market_id = m.market_id group by all order by n desc limit 20""")
def category_inventory(v):
    return au.category_inventory(v.markets, v.prices)


_COVERAGE = """select (select count(*) from {0}) as total_facts, (select count(distinct market_id) from {0}) as markets_with_facts,
    (select count(*) from markets m where t_resolve is not null and exists (select 1 from {0} x where x.market_id = m.market_id)) as resolved_with,
    (select count(*) from markets m where t_resolve is not null and not exists (select 1 from {0} x where x.market_id = m.market_id)) as resolved_without"""


@query("coverage_counts", "total_facts:l markets_with_facts:l resolved_with:l resolved_without:l", _COVERAGE.format("trades"))
def coverage_counts(v):
    return au.coverage_counts(v.markets, v.trades)


@query("coverage_counts_prices", "total_facts:l markets_with_facts:l resolved_with:l resolved_without:l", _COVERAGE.format("prices"))
def coverage_counts_prices(v):
    return au.coverage_counts(v.markets, v.prices)


@query("price_depth_having", "depth n_markets:l", """
    with n as (select market_id, count(*) as n from prices group by all)
    select 'n_60' as depth, count(*) filter (n >= 60) as n_markets from n union all select 'n_100', count(*) filter (n >= 100) from n
    union all select 'n_1440', count(*) filter (n >= 1440) from n""")
def price_depth_having(v):
    return au.depth_counts(v.prices, [60, 100, 1440])


@query("conditional_distinct", "status targets:l with_records:l many_records:l", """
    select status, count(distinct target) as targets, count(distinct case when n_records > 0 then target end) as with_records,
      count(distinct case when n_records >= 500 then target end) as many_records from runs group by status""")
def conditional_distinct(v):
    n = F.col("n_records")
    return distinct_counts(v.runs, ["status"], "target", {"targets": F.lit(True), "with_records": n > 0, "many_records": n >= 500})


@query("exclusive_groups", "market_id event_group is_bucket_market:b", """
    with m as (select * from markets m where t_resolve >= timestamp '2024-01-01' and outcome in (0, 1) and volume >= 500
               and exists (select 1 from trades t where t.market_id = m.market_id)),
    g as (select event_group from m where not neg_risk group by all having count(*) >= 3 and sum(outcome) = 1)
    select market_id, event_group, coalesce(neg_risk, false) or event_group in (select event_group from g) as is_bucket_market from m""")
def exclusive_groups(v):
    return au.exclusive_groups(v.markets, v.trades, F.expr("timestamp '2024-01-01'"), 500)


@query("flag_counts", "flag n:l", "select unnest(flags) as flag, count(*) as n from scored group by 1")
def flag_counts(v):
    return au.flag_counts(v.scored)


@query("tier_coverage", "tier:l n:l avg_confidence:d", "select tier, count(*) as n, round(avg(confidence), 2) as avg_confidence from news group by tier")
def tier_coverage(v):
    return au.tier_coverage(v.news)


@query("coverage_funnel", "step:l stage n:l dropped:l", """
    with s as (select 1 as step, 'resolved_total' as stage, count(t_resolve) as n from markets
      union all select 2, 'got_tnews', count(*) from news union all select 3, 'got_label_row', count(*) from scored
      union all select 4, 'got_ils', count(ils) from scored)
    select *, coalesce(lag(n) over (order by step) - n, 0) as dropped from s""")
def coverage_funnel(v):
    return au.coverage_funnel(v.markets, v.news, v.scored)


@query("ils_by_category", "category n_markets:l ils_min:d p25:d median:d p75:d ils_max:d avg_vol_pre:d avg_hhi:d", """
    select category, count(*) as n_markets, round(min(ils), 3) as ils_min, round(quantile_cont(ils::double, 0.25), 3) as p25,
      round(quantile_cont(ils::double, 0.5), 3) as median, round(quantile_cont(ils::double, 0.75), 3) as p75, round(max(ils), 3) as ils_max,
      round(avg(volume_pre_share), 3) as avg_vol_pre, round(avg(wallet_hhi), 3) as avg_hhi
    from scored where ils is not null group by category""")
def ils_by_category(v):
    return au.ils_by_category(v.scored)


@query("evidence_domains", "domain n:l", """
    select regexp_extract(evidence_url, 'https?://([^/]+)', 1) as domain, count(*) as n from markets
    where evidence_url is not null group by all order by n desc, domain limit 15""")
def evidence_domains(v):
    return au.evidence_domains(v.markets)


@query("url_domain", "page_id:l domain short", """
    select page_id, regexp_extract(url, 'https?://([^/]+)', 1) as domain, split_part(split_part(url, '/', 3), '.', 2) || '.' ||
      split_part(split_part(url, '/', 3), '.', 3) as short from pages""")
def url_domain(v):
    return v.pages.select("page_id", au.domain(F.col("url")).alias("domain"), au.short_domain(F.col("url")).alias("short"))


@query("daily_price_path", "market_id day:t avg_mid:d n_points:l avg_inverted:d", """
    select market_id, date_trunc('day', ts)::timestamp as day, avg(mid_price::double) as avg_mid, count(*) as n_points,
      1 - avg(mid_price::double) as avg_inverted from prices group by all""")
def daily_price_path(v):
    return au.daily_price_path(v.prices)


@query("cross_market_wallets", "address n_markets:l volume:d earliest_trade:t total_markets:l market_ids", """
    with tm as (select taker_address as address, count(distinct market_id) as total_markets from trades group by all),
    s as (select t.* from trades t join markets m on m.market_id = t.market_id where m.category = 'military_geopolitics')
    select s.taker_address as address, count(distinct s.market_id) as n_markets, sum(notional_usdc) as volume, min(ts) as earliest_trade,
      any_value(tm.total_markets) as total_markets, array_to_string(list_sort(list(distinct s.market_id)), ',') as market_ids
    from s join tm on tm.address = s.taker_address group by 1 having count(distinct s.market_id) >= 2""")
def cross_market_wallets(v):
    d = au.cross_market_wallets(v.trades, v.markets.where("category = 'military_geopolitics'"))
    return d.withColumn("market_ids", F.array_join("market_ids", ","))


_RANKED = SERIES + """,
    refs as (select m.market_id, b.t_news, m.outcome as p_resolve from sc m join best b on b.market_id = m.market_id),
""" + WALLETS + """, tm as (select taker_address as address, count(distinct market_id) as total_markets from trades group by all),
    r as (select *, row_number() over (partition by market_id order by notional {0}, address) as rnk from aligned)
    select r.market_id, r.rnk as rank, r.address, r.notional, 100 * r.notional::double / sum(r.notional::double) over (partition by r.market_id) as share_pct,
      r.n_trades, r.avg_inverted, round((epoch_us(r.t_news) - epoch_us(r.first_ts)) / 60000000.0, 1) as lead_minutes,
      tm.total_markets, w.first_seen_venue_at from r left join tm on tm.address = r.address
      left join wallets w on w.address = r.address where r.rnk <= 10"""
_RANKED_COLS = ("market_id rank:l address notional:d share_pct:d n_trades:l avg_inverted:d lead_minutes:d total_markets:l "
                "first_seen_venue_at:t")


def _ref(v):
    return (plan.scorable(v.markets).join(feat.best_news(v.news), "market_id")
            .select("market_id", "t_news", F.col("outcome").alias("p_resolve")))


@query("top_wallets", _RANKED_COLS, _RANKED.format("desc"))
def top_wallets(v):
    return au.ranked_wallets(v.trades, _ref(v), v.wallets)


@query("bottom_wallets", _RANKED_COLS, _RANKED.format("asc"))
def bottom_wallets(v):
    return au.ranked_wallets(v.trades, _ref(v), v.wallets, largest=False)


@query("market_trade_stats", "market_id n_trades:l first_trade:t last_trade:t min_price:d max_price:d avg_price:d n_valid:l", """
    select market_id, count(*) as n_trades, min(ts) as first_trade, max(ts) as last_trade, min(price) as min_price, max(price) as max_price,
      avg(price::double) as avg_price, count(*) filter (price > 0) as n_valid from trades group by all order by n_trades desc, market_id limit 20""")
def market_trade_stats(v):
    return au.market_trade_stats(v.trades)


@query("run_ledger_stats", "collector status runs:l avg_records:d total_records:l targets:l zero_runs:l", """
    select collector, status, count(*) as runs, avg(n_records) as avg_records, sum(n_records) as total_records,
      count(distinct target) as targets, count(*) filter (n_records = 0) as zero_runs from runs group by all""")
def run_ledger_stats(v):
    return au.run_stats(v.runs)


@query("run_reruns", "target runs:l total_written:l", """
    select target, count(*) as runs, sum(n_records) as total_written from runs where status = 'success' group by all
    order by runs desc, target limit 10""")
def run_reruns(v):
    return au.reruns(v.runs)


@query("freshest_run", "target run_id:l started_at:t status n_records:l", """
    select * from (select *, row_number() over (partition by target order by started_at desc, run_id desc) as rn from runs) where rn = 1""")
def freshest_run(v):
    return au.latest_runs(v.runs, "target")


@query("freshness_buckets", "bucket n:l", f"""
    select case when last_refreshed_at > {AS_OF} - interval 1 day then '<1d' when last_refreshed_at > {AS_OF} - interval 7 day then '1-7d'
      when last_refreshed_at > {AS_OF} - interval 30 day then '7-30d' else '>30d' end as bucket, count(*) as n from markets group by all""")
def freshness_buckets(v):
    return au.freshness_buckets(v.markets, F.expr(AS_OF))


@query("wallet_activity_rank", "address n_trades:l", f"""
    select w.address, t.n as n_trades from wallets w join (select taker_address, count(*) as n from trades group by all) t
      on t.taker_address = w.address where (w.last_refreshed_at < {AS_OF} - interval 20 day or w.first_seen_chain_at is null)
      and t.n >= 40""")
def wallet_activity_rank(v):
    return fi.active_stale_wallets(v.wallets, v.trades, F.expr(AS_OF), 20, 40)


@query("share_of_total", "category n:l pct:d", """
    select coalesce(category, '(uncategorised)') as category, count(*) as n,
      round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from markets group by all""")
def share_of_total(v):
    return au.counts_by(v.markets, F.col("category"), "category", "(uncategorised)")


@query("share_of_total_window", "event_type n:l pct:d", """
    select event_type, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from events group by all""")
def share_of_total_window(v):
    return au.counts_by(v.events, F.col("event_type"), "event_type")


@query("label_outcome_counts", "p_resolve:l n:l", "select p_resolve, count(*) as n from scored group by all")
def label_outcome_counts(v):
    return v.scored.groupBy("p_resolve").agg(F.count("*").alias("n"))


@query("label_health", "p_resolve:l n:l pct_defined:d n_null:l n_low_information:l ils_min:d ils_max:d", """
    select p_resolve, count(*) as n, round(100.0::double * count(ils) / count(*), 1) as pct_defined, count(*) filter (ils is null) as n_null,
      count(*) filter (list_contains(flags, 'low_information_market')) as n_low_information, min(ils) as ils_min, max(ils) as ils_max
    from scored group by all""")
def label_health(v):
    return au.label_health(v.scored)


@query("lifecycle_coverage", "market_id n_prices:l min_ts:t max_ts:t coverage", """
    with p as (select market_id, count(*) as n, min(ts) as lo, max(ts) as hi from prices group by all)
    select m.market_id, coalesce(p.n, 0) as n_prices, p.lo as min_ts, p.hi as max_ts,
      case when p.n is null then 'none' when m.t_open is null or m.t_resolve is null then 'incomplete'
           when p.lo <= m.t_open and p.hi >= m.t_resolve then 'full' else 'partial' end as coverage
    from markets m left join p on p.market_id = m.market_id""")
def lifecycle_coverage(v):
    return au.lifecycle_coverage(v.markets, v.prices)


@query("data_gap_hypotheses", "h1:b h2:b h3:b h4:b h5:b", f"""
    with a as (select count(t_resolve) as resolved, count(*) filter (category in ('politics_us', 'politics_intl', 'geopolitics', 'military_geopolitics')) as pol from markets),
    b as ({_COVERAGE.format("trades")}), c as ({_COVERAGE.format("prices")}),
    w as (select count(*) as n, count(first_seen_chain_at) as chain, count(*) filter (last_refreshed_at < {AS_OF} - interval 30 day or first_seen_chain_at is null) as stale from wallets),
    e as (select count(*) as n from markets m where t_resolve is not null and evidence_url is not null and not exists (select 1 from news n where n.market_id = m.market_id)),
    nn as (select count(*) as n from news)
    select a.pol < greatest(50, a.resolved * 0.15) as h1, b.resolved_with = 0 or b.resolved_without > a.resolved * 0.5 as h2,
      w.stale > w.n * 0.8 or w.chain = 0 as h3, e.n > 0 as h4, c.resolved_with > 0 and nn.n = 0 as h5 from a, b, c, w, e, nn""")
def data_gap_hypotheses(v):
    return au.data_gap_hypotheses(v.markets, v.trades, v.prices, v.news, v.wallets, F.expr(AS_OF))


@query("collection_diagnosis", "market_id n_trades:l n_runs:l diagnosis recommendation", """
    with t as (select market_id, count(*) as n from trades group by all),
    r as (select target as market_id, count(*) as n_runs, arg_max(n_records, (started_at, run_id)) as lw, bool_or(status = 'success') as ok,
          bool_or(status = 'failed') as bad from runs group by all),
    j as (select m.market_id, m.volume, coalesce(t.n, 0) as n, coalesce(r.n_runs, 0) as nr, coalesce(r.lw, 0) as lw, r.ok, r.bad from markets m
          left join t on t.market_id = m.market_id left join r on r.market_id = m.market_id)
    select market_id, n as n_trades, nr as n_runs,
      case when nr = 0 and n > 0 then 'partial' when nr = 0 then 'never_run'
           when n = 0 and ok and lw = 0 and volume >= 1000000 then 'ran_indexer_failed' when n = 0 and ok and lw = 0 then 'ran_returned_zero'
           when n = 0 and bad then 'ran_indexer_failed' when n > 0 and n < 100 then 'partial' when n >= 100 then 'ok' else 'investigate_further' end as diagnosis,
      case when nr = 0 then 'rerun' when n = 0 and ok and lw = 0 and volume >= 1000000 then 'direct_logs' when n = 0 and ok and lw = 0 then 'rerun'
           when n = 0 and bad and volume >= 50000000 then 'direct_logs' when n = 0 and bad then 'rerun' when n > 0 and n < 100 then 'rerun'
           when n >= 100 then 'ok' else 'investigate_further' end as recommendation from j""")
def collection_diagnosis(v):
    return au.collection_diagnosis(v.markets, v.trades, v.runs)


@query("validity_gates", "tier1_ok:b coverage_ok:b separation_ok:b cases_ok:b low_information_ok:b light", """
    with g as (select (select 100.0 * count(*) filter (tier = 1) from news) / (select count(t_resolve) from markets) >= 20 as tier1_ok,
      (select 100.0 * count(ils) from scored) / (select count(t_resolve) from markets) >= 70 as coverage_ok,
      coalesce((select median(ils::double) from scored where category = 'military_geopolitics') - (select median(ils::double) from scored where category = 'other') >= 0.15, false) as separation_ok,
      (select count(*) from scored where volume_pre_share > 0.9 and ils >= 0.5) >= 2 as cases_ok,
      (select 100.0 * count(*) filter (list_contains(flags, 'low_information_market')) / count(ils) from scored) < 30 as low_information_ok)
    select *, case (not tier1_ok)::int + (not coverage_ok)::int + (not separation_ok)::int + (not cases_ok)::int + (not low_information_ok)::int
      when 0 then 'GREEN' when 1 then 'YELLOW' when 2 then 'YELLOW' else 'RED' end as light from g""")
def validity_gates(v):
    return au.validity_gates(v.markets, v.news, v.scored, F.col("volume_pre_share") > 0.9)


@query("case_status_rollup", "case_id status n:l total:l", """
    select 'case-' || (o_custkey)::varchar as case_id, case o_orderstatus when 'F' then 'ok' when 'O' then 'failed' else 'skipped' end as status,
      count(*) as n, sum(o_orderkey % 50 + o_orderkey % 7) as total from orders group by all""")
def case_status_rollup(v):
    rows = v.orders.select(F.concat(F.lit("case-"), F.col("o_custkey").cast("string")).alias("case_id"),
                           F.expr("case o_orderstatus when 'F' then 'ok' when 'O' then 'failed' else 'skipped' end").alias("status"),
                           (F.col("o_orderkey") % 50).alias("before"), (F.col("o_orderkey") % 7).alias("written"))
    return au.case_status_rollup(rows)


@query("histogram_edges", "category bin:l n:l", """
    with h as (select category, case when ils < -2 then 0 when ils < -1 then 1 when ils < -0.5 then 2 when ils < 0 then 3 when ils < 0.5 then 4
      when ils < 1 then 5 else 6 end as bin from scored where ils is not null)
    select c.category, b.bin, count(h.bin) as n from (select distinct category from h) c cross join (select unnest(range(7)) as bin) b
    left join h on h.category = c.category and h.bin = b.bin group by all""")
def histogram_edges(v):
    return au.histogram(v.scored, ["category"], "ils", C.HISTOGRAM_EDGES)


@query("histogram_even", "category bin:l n:l", """
    with h as (select category, greatest(0, least(9, trunc((ils::double + 0.5) / 0.2))) as bin from scored where ils is not null)
    select c.category, b.bin, count(h.bin) as n from (select distinct category from h) c cross join (select unnest(range(10)) as bin) b
    left join h on h.category = c.category and h.bin = b.bin group by all""")
def histogram_even(v):
    return au.even_histogram(v.scored, ["category"], "ils", -0.5, 1.5, 10)


@query("histogram", "resolution_type bin:l n:l", """
    with h as (select resolution_type, case when ils_dl < -2 then 0 when ils_dl < -1 then 1 when ils_dl < -0.5 then 2 when ils_dl < 0 then 3 when ils_dl < 0.5 then 4
      when ils_dl < 1 then 5 else 6 end as bin from population)
    select c.resolution_type, b.bin, count(h.bin) as n from (select distinct resolution_type from h) c cross join (select unnest(range(7)) as bin) b
    left join h on h.resolution_type = c.resolution_type and h.bin = b.bin group by all""")
def histogram(v):
    return au.histogram(v.population, ["resolution_type"], "ils_dl", C.HISTOGRAM_EDGES)


@query("calibration", "bin:l n:l mean_p:d yes_rate:d brier:d miscalibrated:b", """
    with b as (select least(floor(p_open * 10), 9) as bin, p_open as p, p_resolve as o from population),
    g as (select bin, count(*) as n, avg(p) as mean_p, avg(o) as yes_rate from b group by all)
    select *, (select avg(pow(p - o, 2)) from b) as brier, n >= 5 and abs(mean_p - yes_rate) > 0.4 as miscalibrated from g""")
def calibration(v):
    return au.calibration(v.population, "p_open", "p_resolve")


# ------------------------------------------------------------ windows, sorts
@query("keep_first", "target run_id:l collector", """
    select target, run_id, collector from (select *, row_number() over (partition by target order by run_id) as rn from runs) where rn = 1""")
def keep_first_q(v):
    return keep_first(v.runs, ["target"], ["run_id"])


@query("top_n_per_group", "market_id rank:l tx_hash notional_usdc:d", """
    select market_id, rank, tx_hash, notional_usdc from (select *, row_number() over (partition by market_id order by notional_usdc desc, tx_hash) as rank
      from trades) where rank <= 10""")
def top_n_per_group(v):
    return feat.top_n(v.trades, ["market_id"], [F.desc("notional_usdc"), "tx_hash"], 10)


@query("order_nulls_last", "market_id ils:d", "select market_id, ils from scored order by ils desc nulls last, market_id")
def order_nulls_last(v):
    return v.scored.select("market_id", "ils").orderBy(F.desc_nulls_last("ils"), "market_id")


@query("top_k", "address volume:d", """
    select taker_address as address, sum(notional_usdc) as volume from trades group by all order by volume desc, address limit 20""")
def top_k(v):
    return (v.trades.groupBy(F.col("taker_address").alias("address")).agg(F.sum("notional_usdc").alias("volume"))
            .orderBy(F.desc("volume"), "address").limit(20))


@query("latest_per_key", "collector pos:l run_id:l started_at:t", """
    select collector, rn as pos, run_id, started_at from (select *, row_number() over (partition by collector order by started_at desc, run_id desc) as rn
      from runs) where rn <= 5""")
def latest_per_key(v):
    return au.latest_runs(v.runs, "collector", 5).withColumnRenamed("rank", "pos")


@query("limit_candidates", "market_id pool:l", """
    with todo as (select * from markets m where outcome is not null and t_open is not null and t_resolve is not null
                  and not exists (select 1 from scored s where s.market_id = m.market_id and s.flags[1] is null))
    select market_id, min(pool) as pool from (
      select market_id, 1 as pool from todo where resolution_type = 'deadline_resolved' and market_id in (select market_id from prices)
      union all select market_id, 2 from todo where market_id in (select market_id from news)) group by market_id
    order by pool, market_id limit 50""")
def limit_candidates(v):
    return plan.score_candidates(v.markets, v.prices, v.news, v.scored.where("size(flags) = 0"), 50)


@query("median_by_position", "category median:d", """
    select category, list_sort(list(volume))[(count(*) // 2) + 1] as median from scored group by category""")
def median_by_position(v):
    r = ranked_values(v.scored, ["category"], "volume")
    return value_at_rank(r, ["category"], {"median": F.floor(F.col("total") / 2)})


@query("percentile_truncated_index", "p_resolve:l p5:d p25:d p50:d p75:d p95:d", """
    with s as (select p_resolve, list_sort(list(ils)) as l, count(*) as n from scored where ils is not null group by all)
    select p_resolve, l[least((n * 5) // 100, n - 1) + 1] as p5, l[least((n * 25) // 100, n - 1) + 1] as p25,
      l[least((n * 50) // 100, n - 1) + 1] as p50, l[least((n * 75) // 100, n - 1) + 1] as p75, l[least((n * 95) // 100, n - 1) + 1] as p95 from s""")
def percentile_truncated_index(v):
    r = ranked_values(v.scored, ["p_resolve"], "ils")
    at = {f"p{p}": F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1) for p in (5, 25, 50, 75, 95)}
    return value_at_rank(r, ["p_resolve"], at)


# ------------------------------------------------------------ set operations
@query("union_pools", "market_id pool:l", """
    select market_id, min(pool) as pool from (select market_id, 1 as pool from scored where ils is not null
      union all select market_id, 2 from news) group by market_id""")
def union_pools(v):
    a = v.scored.where("ils is not null").select("market_id", F.lit(1).alias("pool"))
    return a.unionByName(v.news.select("market_id", F.lit(2).alias("pool"))).groupBy("market_id").agg(F.min("pool").alias("pool"))


@query("set_difference", "market_id", """
    select market_id from markets except select market_id from news""")
def set_difference(v):
    return v.markets.select("market_id").join(v.news.select("market_id"), "market_id", "left_anti").distinct()


@query("merge_results", "market_id ils:d source", """
    with old as (select market_id, ils from scored), new as (select market_id, round(ils_dl, 6) as ils from population where in_scope)
    select coalesce(n.market_id, o.market_id) as market_id, case when n.market_id is not null then n.ils else o.ils end as ils,
      case when n.market_id is not null then 'new' else 'old' end as source from old o full join new n on n.market_id = o.market_id""")
def merge_results(v):
    old = v.scored.select("market_id", F.col("ils").cast("double").alias("ils"), F.lit("old").alias("source"))
    new = v.population.where("in_scope").select("market_id", F.col("ils_dl").alias("ils"), F.lit("new").alias("source"))
    return upsert(old, new, ["market_id"])


@query("upsert", "market_id ts:t mid_price:d", """
    select market_id, ts, mid_price::double as mid_price from prices union all
    select market_id, ts, p from (select market_id, date_trunc('minute', ts) as ts, sum(notional_usdc)::double / sum(size_shares)::double as p from trades group by all) s
    where not exists (select 1 from prices q where q.market_id = s.market_id and q.ts = s.ts)""")
def upsert_do_nothing(v):
    from tidemark.operators.series import vwap_buckets
    old = v.prices.select("market_id", "ts", F.col("mid_price").cast("decimal(16,14)").alias("mid_price"))
    return upsert(old, vwap_buckets(v.trades).select("market_id", "ts", "mid_price"), ["market_id", "ts"], "do_nothing")


@query("upsert_coalesce", "market_id t_resolve:t outcome:l category", """
    with new as (select market_id, case when outcome = 1 then t_resolve end as t_resolve, outcome, 'new' as category from markets where category = 'other'),
    old as (select market_id, t_open as t_resolve, 0 as outcome, category from markets where volume >= 100000)
    select coalesce(n.market_id, o.market_id) as market_id,
      case when n.market_id is null then o.t_resolve when o.market_id is null then n.t_resolve else coalesce(n.t_resolve, o.t_resolve) end as t_resolve,
      case when n.market_id is null then o.outcome when o.market_id is null then n.outcome else coalesce(n.outcome, o.outcome) end as outcome,
      case when o.market_id is null then n.category else o.category end as category
    from old o full join new n on n.market_id = o.market_id""")
def upsert_coalesce(v):
    new = v.markets.where("category = 'other'").select(
        "market_id", F.when(F.col("outcome") == 1, F.col("t_resolve")).alias("t_resolve"), "outcome", F.lit("new").alias("category"))
    old = v.markets.where("volume >= 100000").select("market_id", F.col("t_open").alias("t_resolve"), F.lit(0).alias("outcome"), "category")
    return upsert(old, new, ["market_id"], {"t_resolve": "coalesce", "outcome": "coalesce", "category": "keep"})


@query("seed_proxy_news", "market_id t_news:t tier:l confidence:d notes", """
    select coalesce(m.market_id, n.market_id) as market_id, coalesce(m.t_resolve - interval 24 hour, n.t_news) as t_news,
      case when m.market_id is null then n.tier else 2 end as tier, case when m.market_id is null then n.confidence else 0.60 end as confidence,
      case when m.market_id is null then n.notes else 'proxy:resolve-24h:control' end as notes
    from (select * from markets where resolution_type = 'unclassifiable' and t_resolve is not null) m
    full join (select * from news where tier = 2) n on n.market_id = m.market_id""")
def seed_proxy_news(v):
    from tidemark.plans.population import proxy_news
    seeds = proxy_news(v.markets.where("resolution_type = 'unclassifiable' and t_resolve is not null"))
    return upsert(v.news.where("tier = 2").select(*seeds.columns), seeds, ["market_id"])

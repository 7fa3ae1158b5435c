"""Price series, lookups and leakage scores."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.sqlparts import SCORE_COLS, SERIES, WALLETS, scored
from tidemark.operators import features as feat
from tidemark.operators import series as ser
from tidemark.operators.asof import first_at_or_after, nearest_within
from tidemark.plans import scoring as plan


def _scores(df):
    return df.withColumn("flags", F.array_join("flags", ","))


def _series(v):
    return v.history, ser.history_bounds(v.history)


@query("minute_vwap", "market_id ts:t mid_price:d volume:d", """
    select market_id, date_trunc('minute', ts) as ts,
           round_even(greatest(0, least(1, sum(notional_usdc)::double / nullif(sum(size_shares), 0)::double)), 10) as mid_price,
           sum(notional_usdc) as volume from trades group by all""")
def minute_vwap(v):
    return ser.vwap_buckets(v.trades)


@query("hour_vwap", "market_id ts:t mid_price:d volume:d", """
    select market_id, date_trunc('hour', ts) as ts, sum(notional_usdc)::double / sum(size_shares)::double as mid_price,
           sum(notional_usdc) as volume from trades group by all""")
def hour_vwap(v):
    return ser.vwap_buckets(v.trades, "1h")


@query("minute_vwap_weighted", "market_id ts:t mid_price:d", """
    select market_id, date_trunc('minute', ts) as ts, sum(price * notional_usdc)::double / sum(notional_usdc)::double as mid_price
    from trades where outcome_index = 1 group by all having sum(notional_usdc) <> 0""")
def minute_vwap_weighted(v):
    return ser.weighted_price_buckets(v.trades)


@query("cutoff_vwap", "market_id vwap:d n_trades_before:l", """
    select t.market_id, sum(size_shares * price)::double / sum(size_shares)::double as vwap, count(*) as n_trades_before
    from trades t join markets m on m.market_id = t.market_id
    where m.t_resolve is not null and t.ts < m.t_resolve - interval 24 hour group by t.market_id""")
def cutoff_vwap(v):
    return ser.cutoff_vwap(v.trades, _cutoffs(v))


def _cutoffs(v):
    return v.markets.where("t_resolve is not null").select(
        "market_id", (F.col("t_resolve") - F.expr("interval 24 hours")).alias("cutoff"))


@query("forward_fill_minutes", "market_id n:l n_traded:l price_sum:d volume:d first_ts:t last_ts:t", """
    with vw as (select market_id, date_trunc('minute', ts) as ts,
                       sum(notional_usdc)::double / sum(size_shares)::double as p, sum(notional_usdc)::double as volume
                from trades group by all),
    grid as (select market_id, unnest(generate_series(min(ts), max(ts), interval 1 minute)) as ts from vw group by market_id),
    dense as (select g.market_id, g.ts, v.volume, last_value(v.p ignore nulls) over (partition by g.market_id order by g.ts) as p
              from grid g left join vw v on v.market_id = g.market_id and v.ts = g.ts)
    select market_id, count(*) as n, count(volume) as n_traded, sum(p) as price_sum, sum(volume) as volume,
           min(ts) as first_ts, max(ts) as last_ts from dense group by market_id""")
def forward_fill_minutes(v):
    d = ser.fill_minutes(ser.vwap_buckets(v.trades))
    return d.groupBy("market_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("volume") > 0).alias("n_traded"),
        F.sum(F.col("mid_price").cast("double")).alias("price_sum"), F.sum("volume").alias("volume"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("fill_missing_minutes", "market_id ts:t mid_price:d origin", """
    with s as (select market_id, date_trunc('minute', ts) as ts, sum(price * notional_usdc)::double / sum(notional_usdc)::double as p
               from trades where outcome_index = 1 group by all)
    select market_id, ts, mid_price::double as mid_price, 'quote' as origin from prices
    union all select market_id, ts, p, 'trades' from s
      where not exists (select 1 from prices q where q.market_id = s.market_id and q.ts = s.ts)""")
def fill_missing_minutes(v):
    return ser.fill_missing(v.prices, ser.weighted_price_buckets(v.trades))


@query("price_source_choice", "market_id source", """
    with q as (select market_id, count(*) as n from prices group by all), t as (select distinct market_id from trades)
    select coalesce(q.market_id, t.market_id) as market_id, case when n >= 2 then 'quotes' else 'trade_vwap' end as source
    from q full join t on t.market_id = q.market_id where n >= 2 or t.market_id is not null""")
def price_source_choice(v):
    return ser.market_sources(v.prices, v.trades)


@query("best_news_timestamp", "market_id tier:l confidence:d t_news:t", """
    select market_id, tier, confidence, t_news from (select *, row_number() over (partition by market_id
      order by tier, confidence desc, t_news) as rn from news) where rn = 1""")
def best_news_timestamp(v):
    return feat.best_news(v.news)


@query("asof_nearest", "market_id tier:l t_news:t mid_price:d found:t", """
    select n.market_id, n.tier, n.t_news, (arg_min(p.mid_price, (abs(epoch(p.ts - date_trunc('minute', n.t_news))), p.ts))) as mid_price,
           arg_min(p.ts, (abs(epoch(p.ts - date_trunc('minute', n.t_news))), p.ts)) as found
    from news n left join prices p on p.market_id = n.market_id
      and p.ts between date_trunc('minute', n.t_news) - interval 5 minute and date_trunc('minute', n.t_news) + interval 5 minute
    group by all""")
def asof_nearest(v):
    return nearest_within(v.news.select("market_id", "tier", "t_news"), v.prices, "market_id", "t_news", "ts",
                          "mid_price", 5).withColumnRenamed("mid_price_ts", "found")


@query("asof_forward", "market_id t_open:t mid_price:d found:t", """
    select m.market_id, m.t_open, arg_min(p.mid_price, p.ts) as mid_price, min(p.ts) as found
    from markets m left join prices p on p.market_id = m.market_id
     and p.ts between m.t_open and m.t_open + interval 24 hour group by all""")
def asof_forward(v):
    l = v.markets.select("market_id", "t_open", (F.col("t_open") + F.expr("interval 24 hours")).alias("hi"))
    return first_at_or_after(l, v.prices, "market_id", "t_open", "hi", "ts", "mid_price") \
        .withColumnRenamed("mid_price_ts", "found")


@query("asof_sparse_vwap", "market_id tier:l t_news:t mid_price:d", SERIES + """
    select n.market_id, n.tier, n.t_news,
           arg_min(s.p, (abs(epoch(s.ts - date_trunc('minute', n.t_news))), s.ts)) as mid_price
    from news n join bounds b on b.market_id = n.market_id left join series s on s.market_id = n.market_id
      and s.ts between date_trunc('minute', n.t_news) - interval 5 minute and date_trunc('minute', n.t_news) + interval 5 minute
    group by all""")
def asof_sparse_vwap(v):
    s, b = _series(v)
    asked = v.news.select("market_id", F.col("tier").cast("string").alias("kind"), F.col("t_news").alias("t"),
                          F.lit(False).alias("forward"))
    return ser.lookup_prices(asked, s, b).select("market_id", F.col("kind").alias("tier"), F.col("t").alias("t_news"),
                                                 "mid_price")


@query("price_at", "market_id t:t price:d source", """
    with l as (select distinct market_id, t_news as t from news),
    q as (select l.market_id, l.t, arg_min(p.mid_price, (abs(epoch(p.ts - date_trunc('minute', l.t))), p.ts)) as price
          from l join prices p on p.market_id = l.market_id and p.ts between date_trunc('minute', l.t) - interval 5 minute
            and date_trunc('minute', l.t) + interval 5 minute group by all),
    w as (select l.market_id, l.t, sum(x.notional_usdc)::double / sum(x.size_shares)::double as price
          from l join trades x on x.market_id = l.market_id and x.ts between date_trunc('minute', l.t) - interval 5 minute
            and date_trunc('minute', l.t) + interval 5 minute group by all)
    select l.market_id, l.t, coalesce(q.price::double, w.price) as price,
           case when q.price is not null then 'quotes' when w.price is not null then 'trade_vwap' else 'not_found' end as source
    from l left join q on q.market_id = l.market_id and q.t = l.t left join w on w.market_id = l.market_id and w.t = l.t""")
def price_at(v):
    return ser.price_at(v.news.select("market_id", F.col("t_news").alias("t")).distinct(), v.prices, v.trades)


@query("baseline_price", "market_id baseline_price:d baseline_source n_trades_before:l", """
    with c as (select market_id, t_resolve - interval 24 hour as cutoff from markets where t_resolve is not null),
    q as (select c.market_id, arg_max(p.mid_price, p.ts) as price from c join prices p on p.market_id = c.market_id
          and p.ts < c.cutoff group by all),
    w as (select c.market_id, sum(t.size_shares * t.price)::double / sum(t.size_shares)::double as vwap, count(*) as n
          from c join trades t on t.market_id = c.market_id and t.ts < c.cutoff group by all)
    select c.market_id, coalesce(q.price::double, 1 - w.vwap) as baseline_price,
           case when q.price is not null then 'quote_mid' when w.vwap is not null then 'trade_vwap' else 'none' end as baseline_source,
           case when q.price is not null then -1 else coalesce(w.n, 0) end as n_trades_before
    from c left join q on q.market_id = c.market_id left join w on w.market_id = c.market_id""")
def baseline_price(v):
    return ser.baseline_price(_cutoffs(v), v.prices, v.trades)


@query("trades_in_window", "market_id n:l volume:d", SERIES + """
    select t.market_id, count(*) as n, sum(t.notional_usdc) as volume from trades t join sc m on m.market_id = t.market_id
    join best b on b.market_id = t.market_id where t.ts >= m.t_open and t.ts <= b.t_news group by t.market_id""")
def trades_in_window(v):
    w = plan.scorable(v.markets).join(feat.best_news(v.news), "market_id").select("market_id", "t_open", "t_news")
    return (feat.trades_in_window(v.trades, w, "t_open", "t_news").groupBy("market_id")
            .agg(F.count("*").alias("n"), F.sum("notional_usdc").alias("volume")))


@query("volume_features", "market_id n_trades_total:l n_trades_pre_news:l volume_pre_share:d pre_news_max_jump:d", SERIES + """,
    refs as (select m.market_id, b.t_news, m.t_resolve from sc m join best b on b.market_id = m.market_id)
    select r.market_id, count(*) filter (t.ts <= r.t_resolve) as n_trades_total,
           count(*) filter (t.ts < r.t_news) as n_trades_pre_news,
           round_even((coalesce(sum(t.notional_usdc) filter (t.ts < r.t_news), 0))::double
                 / (sum(t.notional_usdc) filter (t.ts <= r.t_resolve))::double, 6) as volume_pre_share,
           max(t.notional_usdc) filter (t.ts < r.t_news) as pre_news_max_jump
    from refs r left join trades t on t.market_id = r.market_id group by r.market_id""")
def volume_features(v):
    refs = plan.scorable(v.markets).join(feat.best_news(v.news), "market_id")
    return feat.volume_features(v.trades, refs.select("market_id", "t_news", "t_resolve"))


_WALLET_REFS = SERIES + """,
    refs as (select m.market_id, b.t_news, m.outcome as p_resolve from sc m join best b on b.market_id = m.market_id),
""" + WALLETS


def _wallet_refs(v):
    return (plan.scorable(v.markets).join(feat.best_news(v.news), "market_id")
            .select("market_id", "t_news", F.col("outcome").alias("p_resolve")))


@query("wallet_hhi_top10", "market_id wallet_hhi_top10:d", _WALLET_REFS + """
    select market_id, round_even(sum(notional::double * notional::double) / pow(sum(notional::double), 2), 6) as wallet_hhi_top10
    from top10 group by market_id""")
def wallet_hhi_top10(v):
    return feat.wallet_features(v.trades, _wallet_refs(v))


@query("time_to_news_top10", "market_id pos:l address minutes_before_news:d notional_usdc:d", _WALLET_REFS + """
    select market_id, rank as pos, address, round((epoch_us(t_news) - epoch_us(first_ts)) / 60000000.0, 1) as minutes_before_news,
           notional as notional_usdc from top10""")
def time_to_news_top10(v):
    w = feat.wallet_features(v.trades, _wallet_refs(v))
    return w.select("market_id", F.posexplode("time_to_news_top10").alias("pos", "x")) \
        .select("market_id", (F.col("pos") + 1).alias("pos"), "x.*")


@query("ils_standard", SCORE_COLS, SERIES + """,
    refs as (select m.market_id, m.t_open, b.t_news as t_ref, m.t_resolve, m.outcome as p_resolve, []::varchar[] as lead
             from sc m join best b on b.market_id = m.market_id),
""" + scored("refs") + " select * from scores")
def ils_standard(v):
    s, b = _series(v)
    return _scores(plan.score(plan.standard_refs(v.markets, v.news), s, b))


_DL_REFS = """,
    ev1 as (select b.market_id, b.t_news as t_event from best b join sc m on m.market_id = b.market_id where m.outcome = 1),
    raw as (select m.market_id, m.t_open, m.t_resolve, m.outcome as p_resolve, e.t_event,
              coalesce(e.t_event - interval 1 minute, m.t_resolve - interval 1 hour) as t0
            from {base} m left join ev1 e on e.market_id = m.market_id where {cond}),
    {name} as (select market_id, t_open, case when t0 <= t_open then t_open else t0 end as t_ref, t_resolve, p_resolve,
              list_filter([case when t_event is not null then 't_event_recovered' end,
                           case when t0 <= t_open then 'lookback_predates_topen' end], lambda x: x is not null) as lead
              {extra} from raw)
"""


@query("ils_deadline", SCORE_COLS, SERIES + _DL_REFS.format(base="sc", cond="true", name="refs", extra="") + ","
       + scored("refs") + " select * from scores")
def ils_deadline(v):
    s, b = _series(v)
    yes = plan.scorable(v.markets).where("outcome = 1").select("market_id")
    events = feat.best_news(v.news).join(yes, "market_id", "left_semi").withColumnRenamed("t_news", "t_event")
    return _scores(plan.score(plan.deadline_refs(v.markets, events), s, b))


@query("ils_windows", "market_id win ils:d", SERIES + """,
    refs as (select m.market_id, m.t_open, b.t_news as t_ref, m.t_resolve, m.outcome as p_resolve, []::varchar[] as lead
             from sc m join best b on b.market_id = m.market_id),
""" + scored("refs") + """ select market_id, w as win, ils from (
    unpivot (select market_id, ils_30min, ils_2h, ils_6h, ils_24h, ils_7d from scores)
    on ils_30min, ils_2h, ils_6h, ils_24h, ils_7d into name w value ils)""")
def ils_windows(v):
    s, b = _series(v)
    d = plan.score(plan.standard_refs(v.markets, v.news), s, b)
    names = ["ils_30min", "ils_2h", "ils_6h", "ils_24h", "ils_7d"]
    return d.unpivot(["market_id"], names, "win", "ils").where("ils is not null")


@query("topen_snap", "market_id t_open:t snapped:b", SERIES + """
    select m.market_id, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000 then b.first_ts else m.t_open end as t_open,
           epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000 as snapped
    from sc m join bounds b on b.market_id = m.market_id""")
def topen_snap(v):
    _, b = _series(v)
    return plan.snap_open(plan.scorable(v.markets), b).withColumnRenamed("t_open_snapped", "snapped")


_LABEL_CTES = SERIES + """,
    snapped as (select m.*, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000 then b.first_ts else m.t_open end as t_snap
                from sc m join bounds b on b.market_id = m.market_id),
    sm as (select market_id, t_snap as t_open, t_resolve, outcome, resolution_type from snapped)
""" + _DL_REFS.format(base="sm", cond="m.resolution_type = 'deadline_resolved'", name="dl", extra=", coalesce(t_event, t_resolve - interval 1 hour) as t_news") + """,
    refs as (select * from dl union all
      select m.market_id, m.t_open, b.t_news, m.t_resolve, m.outcome, []::varchar[], b.t_news from sm m
      join best b on b.market_id = m.market_id where m.resolution_type is null or m.resolution_type <> 'deadline_resolved'),
""" + scored("refs") + "," + WALLETS + """,
    hhi as (select market_id, round_even(sum(notional::double * notional::double) / pow(sum(notional::double), 2), 6) as h
            from top10 group by market_id),
    vol as (select r.market_id, count(t.tx_hash) filter (t.ts <= r.t_resolve) as n_total, count(t.tx_hash) filter (t.ts < r.t_news) as n_pre,
              round_even((coalesce(sum(t.notional_usdc) filter (t.ts < r.t_news), 0))::double
                    / (sum(t.notional_usdc) filter (t.ts <= r.t_resolve))::double, 6) as share,
              max(t.notional_usdc) filter (t.ts < r.t_news) as jump
            from refs r left join trades t on t.market_id = r.market_id group by r.market_id),
    labels_out as (select s.*, m.category, m.resolution_type, vol.n_total as n_trades_total, vol.n_pre as n_trades_pre_news,
        vol.share as volume_pre_share, vol.jump as pre_news_max_jump, hhi.h as wallet_hhi_top10,
        case when m.resolution_type = 'deadline_resolved' and m.outcome = 0 then null else b.tier end as t_news_tier
      from scores s join sc m on m.market_id = s.market_id join vol on vol.market_id = s.market_id
      left join hhi on hhi.market_id = s.market_id left join best b on b.market_id = s.market_id)
"""


@query("market_labels", SCORE_COLS + " t_news:t category resolution_type n_trades_total:l n_trades_pre_news:l volume_pre_share:d "
       "pre_news_max_jump:d wallet_hhi_top10:d t_news_tier:l", _LABEL_CTES + " select * from labels_out")
def market_labels(v):
    return _scores(plan.market_labels(v.markets, v.prices, v.trades, v.news, history=v.history))


@query("label_audit_append", "market_id event_type ils:d flags resolution_type t_news_tier:l", _LABEL_CTES + """
    select market_id, 'label_computed' as event_type, ils, flags, resolution_type, t_news_tier from labels_out""")
def label_audit_append(v):
    a = plan.label_audit(plan.market_labels(v.markets, v.prices, v.trades, v.news, history=v.history))
    j = F.from_json("details", "ils string, flags array<string>, resolution_type string, t_news_tier int")
    return a.withColumn("j", j).select("market_id", "event_type", "j.ils", F.array_join("j.flags", ",").alias("flags"),
                                       "j.resolution_type", "j.t_news_tier")


@query("score_candidates", "market_id pool:l", """
    with todo as (select * from markets m where outcome is not null and t_open is not null and t_resolve is not null
                  and not exists (select 1 from scored s where s.market_id = m.market_id and s.flags[1] is null))
    select market_id, min(pool) as pool from (
      select market_id, 1 as pool from todo where resolution_type = 'deadline_resolved'
        and market_id in (select market_id from prices)
      union all select market_id, 2 from todo where market_id in (select market_id from news)) group by market_id""")
def score_candidates(v):
    return plan.score_candidates(v.markets, v.prices, v.news, v.scored.where("size(flags) = 0"))


@query("ils_offset_sweep", "market_id offset_hours:l p_ref:d ils:d", SERIES + """,
    o as (select unnest([24, 6, 2, 1]) as h),
    snapped as (select m.market_id, m.t_resolve, m.outcome as p_resolve, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000
                  then b.first_ts else m.t_open end as t_open from sc m join bounds b on b.market_id = m.market_id),
    op as (select r.market_id, arg_min(s.p, s.ts) as p_open from snapped r join series s on s.market_id = r.market_id
           and s.ts between date_trunc('minute', r.t_open) and date_trunc('minute', r.t_open) + interval 24 hour group by all),
    q as (select r.*, o.h, r.t_resolve - to_hours(o.h) as t from snapped r, o),
    rp as (select q.market_id, q.h, arg_min(s.p, (abs(epoch(s.ts - date_trunc('minute', q.t))), s.ts)) as p_ref
           from q join series s on s.market_id = q.market_id and s.ts between date_trunc('minute', q.t) - interval 5 minute
             and date_trunc('minute', q.t) + interval 5 minute where q.t >= q.t_open group by all)
    select q.market_id, q.h as offset_hours, rp.p_ref, case when abs(q.p_resolve - op.p_open) >= 0.05
       then round_even((rp.p_ref - op.p_open) / (q.p_resolve - op.p_open), 6) end as ils
    from q left join op on op.market_id = q.market_id left join rp on rp.market_id = q.market_id and rp.h = q.h""")
def ils_offset_sweep(v):
    return plan.offset_sweep(v.markets, v.prices, v.trades, history=v.history)


@query("ils_reference_compare", "market_id ils_proxy:d ils_report:d delta:d", SERIES + """,
    snapped as (select m.market_id, m.t_resolve, m.outcome as p_resolve, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000
                  then b.first_ts else m.t_open end as t_open from sc m join bounds b on b.market_id = m.market_id),
    op as (select r.market_id, arg_min(s.p, s.ts) as p_open from snapped r join series s on s.market_id = r.market_id
           and s.ts between date_trunc('minute', r.t_open) and date_trunc('minute', r.t_open) + interval 24 hour group by all),
    q as (select r.*, n.t_news as t, n.tier from snapped r join news n on n.market_id = r.market_id where n.tier in (2, 3)),
    rp as (select q.market_id, q.tier, arg_min(s.p, (abs(epoch(s.ts - date_trunc('minute', q.t))), s.ts)) as p_ref
           from q join series s on s.market_id = q.market_id and s.ts between date_trunc('minute', q.t) - interval 5 minute
             and date_trunc('minute', q.t) + interval 5 minute group by all),
    r as (select q.market_id, q.tier, case when abs(q.p_resolve - op.p_open) >= 0.05
       then round_even((rp.p_ref - op.p_open) / (q.p_resolve - op.p_open), 6) end as ils
       from q left join op on op.market_id = q.market_id left join rp on rp.market_id = q.market_id and rp.tier = q.tier)
    select a.market_id, a.ils as ils_proxy, b.ils as ils_report, b.ils - a.ils as delta
    from r a join r b on b.market_id = a.market_id where a.tier = 3 and b.tier = 2""")
def ils_reference_compare(v):
    return plan.reference_compare(v.markets, v.prices, v.trades, v.news.where("tier = 3"), v.news.where("tier = 2"), v.history)


@query("timing_label", "market_id address first_trade:t timing", """
    with c as (select market_id, max(case when tier = 3 then t_news end) as tp, max(case when tier = 2 then t_news end) as tr
               from news group by market_id having max(case when tier = 3 then 1 end) = 1 and max(case when tier = 2 then 1 end) = 1),
    f as (select market_id, taker_address as address, min(ts) as first_trade from trades
          where side = 'BUY' and outcome_index = 1 group by all)
    select f.market_id, f.address, f.first_trade, case when f.first_trade < tp and f.first_trade < tr then 'PRE_BOTH'
       when f.first_trade < tp then 'PRE_PROXY_ONLY' else 'POST_BOTH' end as timing
    from f join c on c.market_id = f.market_id""")
def timing_label(v):
    c = (v.news.groupBy("market_id").agg(F.max(F.when(F.col("tier") == 3, F.col("t_news"))).alias("tp"),
                                         F.max(F.when(F.col("tier") == 2, F.col("t_news"))).alias("tr"))
         .where("tp is not null and tr is not null"))
    f = (v.trades.where("side = 'BUY' and outcome_index = 1")
         .groupBy("market_id", F.col("taker_address").alias("address")).agg(F.min("ts").alias("first_trade")))
    return f.join(c, "market_id").withColumn("timing", plan.timing_label(F.col("first_trade"), F.col("tp"), F.col("tr")))

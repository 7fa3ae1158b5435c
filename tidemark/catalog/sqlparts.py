"""SQL fragments shared by several twins. They follow the definitions directly: the traded series is
really filled minute by minute here, while the library answers lookups from sparse buckets."""

SERIES = """
with vw as (select market_id, date_trunc('minute', ts) as ts,
                   greatest(0, least(1, sum(notional_usdc)::double / sum(size_shares)::double)) as p,
                   sum(notional_usdc)::double as volume
            from trades group by all having sum(size_shares) > 0),
nq as (select market_id, count(*) as n from prices group by all having count(*) >= 2),
grid as (select market_id, unnest(generate_series(min(ts), max(ts), interval 1 minute)) as ts
         from vw where market_id not in (select market_id from nq) group by market_id),
dense as (select g.market_id, g.ts, last_value(v.p ignore nulls) over
                 (partition by g.market_id order by g.ts) as p, coalesce(v.volume, 0) as volume
          from grid g left join vw v on v.market_id = g.market_id and v.ts = g.ts),
series as (select market_id, ts, mid_price::double as p, 'quotes' as source from prices
           where market_id in (select market_id from nq)
           union all select market_id, ts, p, 'trade_vwap' from dense),
bounds as (select market_id, source, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_points,
                  arg_min(p, ts) as first_price from series group by all),
best as (select market_id, t_news, tier from (select *, row_number() over (partition by market_id
           order by tier, confidence desc, t_news) as rn from news) where rn = 1),
sc as (select * from markets where outcome is not null and t_open is not null and t_resolve is not null)
"""

WINDOWS = [("30min", 30), ("2h", 120), ("6h", 360), ("24h", 1440), ("7d", 10080)]


def scored(refs: str) -> str:
    """CTEs that score refs(market_id, t_open, t_ref, t_resolve, p_resolve, lead) into ``scores``."""
    kinds = " union all ".join(
        [f"select market_id, t_open, '{w}' as kind, t_ref - interval {m} minute as t from refs"
         for w, m in WINDOWS])
    price = ", ".join(f"max(case when kind = '{k}' then p end) as p_{k}"
                      for k in ["open", "ref"] + [w for w, _ in WINDOWS])
    early = {w: f"t_ref - interval {m} minute < t_open" for w, m in WINDOWS}
    ils_w = ", ".join(
        f"""case when p_open is not null and p_ref is not null and not ({early[w]}) and abs(p_resolve - p_{w}) >= 0.05
            then round_even((p_ref - p_{w}) / (p_resolve - p_{w}), 6) end as ils_{w}""" for w, _ in WINDOWS)
    flag_w = ", ".join(
        f"""case when {early[w]} then 'window_{w}_predates_topen'
            when p_{w} is null then 'price_history_gap_window_{w}' end""" for w, _ in WINDOWS)
    return f"""
asked as (select market_id, t_open, 'ref' as kind, t_ref as t from refs union all {kinds}),
near as (select a.market_id, a.kind, arg_min(s.p, (abs(epoch(s.ts - date_trunc('minute', a.t))), s.ts)) as p
         from asked a join series s on s.market_id = a.market_id
          and s.ts between date_trunc('minute', a.t) - interval 5 minute and date_trunc('minute', a.t) + interval 5 minute
         where a.kind = 'ref' or a.t >= a.t_open group by all
         union all
         select r.market_id, 'open', arg_min(s.p, s.ts) from refs r join series s on s.market_id = r.market_id
          and s.ts between date_trunc('minute', r.t_open) and date_trunc('minute', r.t_open) + interval 24 hour
         group by all),
wide as (select r.*, b.source as price_source, n.* exclude (market_id) from refs r join bounds b on b.market_id = r.market_id
         left join (select market_id, {price} from near group by market_id) n on n.market_id = r.market_id),
scores as (select *, case when p_open is null then 'price_gap_topen' when p_ref is null then 'price_gap_tref'
                     else 'ok' end as status,
             case when p_open is not null and p_ref is not null then p_ref - p_open end as delta_pre,
             case when p_open is not null and p_ref is not null then p_resolve - p_open end as delta_total,
             case when p_open is not null and p_ref is not null and abs(p_resolve - p_open) >= 0.05
                  then round_even((p_ref - p_open) / (p_resolve - p_open), 6) end as ils, {ils_w},
             array_to_string(case when p_open is null then ['price_history_gap_at_topen']
               when p_ref is null then list_concat(lead, ['price_history_gap_at_tref'])
               else list_concat(lead, list_filter([case when abs(p_resolve - p_open) < 0.05
                    then 'low_information_market' end, {flag_w}], lambda x: x is not null)) end, ',') as flags
           from wide)"""


SCORE_COLS = ("market_id t_open:t t_ref:t p_resolve:l price_source status p_open:d p_ref:d delta_pre:d delta_total:d "
              "ils:d ils_30min:d ils_2h:d ils_6h:d ils_24h:d ils_7d:d flags")

WALLETS = """
aligned as (select t.market_id, t.taker_address as address, r.t_news, sum(t.notional_usdc) as notional,
              min(t.ts) as first_ts, count(*) as n_trades, avg(1 - t.price::double) as avg_inverted
            from trades t join refs r on r.market_id = t.market_id
            where t.ts < r.t_news and t.side = case when r.p_resolve = 1 then 'BUY' else 'SELL' end
              and t.outcome_index = r.p_resolve group by all),
top10 as (select * from (select *, row_number() over (partition by market_id order by notional desc, address) as rank
          from aligned) where rank <= 10)
"""

"""Stand-in market tables derived from the generic test tables.

Each view is one SQL text that means the same in Spark and in DuckDB; the few functions that are
spelled differently go through a small per-engine word book. Two views over the largest tables have a
text of their own for Spark, of the same rows, which reads these tables once. The library never depends
on this module: only the query catalog and the tests do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ensure_utc, stage_folder

BASE_TABLES = ["events", "orders", "lineitem", "part", "supplier", "customer", "documents", "pages"]


@dataclass(frozen=True)
class Dialect:
    us: str          # timestamp -> microseconds
    from_us: str     # microseconds -> timestamp
    iso: str         # timestamp -> ISO text in whole seconds
    ymdhms: str      # timestamp -> yyyyMMddHHmmss
    prop_k: str      # market number inside the props JSON
    compact: str     # drop NULLs from an array literal
    collect: str     # aggregate strings to one text, ordered by themselves
    bs: str          # one backslash inside a string literal

    def shift(self, ts: str, seconds: str) -> str:
        return self.from_us.format(f"{self.us.format(ts)} + cast({seconds} as bigint) * 1000000")


SPARK = Dialect(
    us="unix_micros(cast({} as timestamp))", from_us="timestamp_micros({})",
    iso="date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", ymdhms="date_format({}, 'yyyyMMddHHmmss')",
    prop_k="cast(get_json_object(props, '$.k') as bigint)",
    compact="array_compact(array({}))", collect="array_join(array_sort(collect_list({})), ',')", bs="\\\\",
)
DUCK = Dialect(
    us="epoch_us({})", from_us="make_timestamp({})",
    iso="strftime({}, '%Y-%m-%dT%H:%M:%SZ')", ymdhms="strftime({}, '%Y%m%d%H%M%S')",
    prop_k="cast(json_extract_string(props, '$.k') as bigint)",
    compact="list_filter([{}], lambda x: x is not null)",
    collect="array_to_string(list_sort(list({})), ',')", bs="\\",
)

T0 = "timestamp '2024-01-01 00:00:00'"
DAY = 86400

QUESTIONS = [
    "Will Russia and Ukraine agree to a ceasefire by March 31, 2025?",
    "Will OpenAI launch a new model before June?",
    "Will the FDA approve the new drug in its PDUFA decision?",
    "Will the Lakers win the NBA finals?",
    "Will Bitcoin price stay above the record high?",
    "Will the Senate vote on the tax bill by Q2 2026?",
    "Will Iran strike again no later than 4/30?",
    "Will Apple announce an acquisition by 2026?",
    "Will the prosecutor see a guilty verdict at trial?",
    "Will it rain in the valley?",
    "Will the central bank meeting end with a rate cut before the end of September 17th, 2025?",
    "Will the director resign after the lawsuit settlement?",
]


def market_key(num: str, tag: str = "") -> str:
    """66-character market id from a number."""
    return (f"'0x' || md5('{tag}' || cast({num} as string)) || md5('x{tag}' || cast({num} as string))")


def _pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case {expr} {arms} else '{values[-1]}' end"


def view_sql(d: Dialect) -> dict[str, str]:
    """name -> SELECT; later views may use earlier ones."""
    cat4 = ["military_geopolitics", "corporate_disclosure", "regulatory_decision", "other"]
    v: dict[str, str] = {}
    v["ev"] = f"""
      select event_id, cast(ts as timestamp) as ts, user_id, event_type, {d.prop_k} as k,
             cast(round(value * 100) as bigint) as cents
      from events"""
    v["trades"] = f"""
      select event_id, k, {market_key('k')} as market_id, '0x' || md5(cast(event_id as string)) as tx_hash,
             cast(event_id % 7 as int) as log_index, ts,
             'w' || cast(user_id as string) as taker_address,
             'w' || cast((user_id * 7 + event_id) % 150 as string) as maker_address,
             case when event_id % 3 = 0 then 'SELL' else 'BUY' end as side,
             cast(case when event_id % 5 = 0 then 0 else 1 end as int) as outcome_index,
             cast(cast(cents % 9901 + 50 as decimal(10,0)) * 0.0001 as decimal(8,6)) as price,
             cast(1 + event_id % 500 as decimal(20,6)) as size_shares,
             cast(cast(1 + event_id % 500 as decimal(10,0))
                  * (cast(cents % 9901 + 50 as decimal(10,0)) * 0.0001) as decimal(20,6)) as notional_usdc
      from ev"""
    v["markets"] = f"""
      select num, market_id,
             {_pick('num % 12', QUESTIONS)} || ' Case ' || cast(num as string) || '.' as question,
             case when num % 3 = 0 then null
                  when num % 5 = 0 then 'Resolves yes if it is reported before December 31, 2025.'
                  else 'Resolves by the usual sources.' end as description,
             {_pick('num % 6', ['World', 'Tech', 'Health', 'NBA', 'Crypto', 'Politics'])} as category_raw,
             category, t_open, {d.shift('t_open', f'(num % 90 + 20) * {DAY}')} as end_date,
             t_resolve, outcome, resolution_type,
             case when resolution_type = 'event_resolved' and num % 2 = 0
                  then 'https://news' || cast(num % 9 as string) || '.example.com/a/' || cast(num as string)
             end as evidence_url,
             'p' || cast(num % 17 as string) as proposer, volume,
             cast(volume * 0.25 as decimal(20,6)) as liquidity, 'slug-' || cast(num as string) as slug,
             'g' || cast(cast(floor(num / 4) as bigint) as string) as event_group,
             num % 11 = 0 as neg_risk, coalesce(t_resolve, t_open) as last_refreshed_at
      from (
        select k as num, market_id, {_pick('k % 4', cat4)} as category,
               {d.shift(T0, f'(k % 5) * {DAY}')} as t_open,
               {d.shift(T0, f'(20 + k % 10) * {DAY}')} as t_resolve,
               cast(case when k % 7 = 0 then null else k % 2 end as int) as outcome,
               {_pick('k % 3', ['deadline_resolved', 'event_resolved', 'unclassifiable'])} as resolution_type,
               volume
        from (select k, market_id, cast(sum(notional_usdc) as decimal(20,6)) as volume
              from trades group by k, market_id) t
        union all
        select o_orderkey, {market_key('o_orderkey', 'o')},
               case o_custkey % 6 when 0 then 'military_geopolitics' when 1 then 'corporate_disclosure'
                    when 2 then 'regulatory_decision' when 5 then null else 'other' end,
               cast(o_orderdate as timestamp),
               case when o_orderstatus = 'P' then null
                    else {d.shift('o_orderdate', f'(o_custkey % 60 + 1) * {DAY}')} end,
               cast(case o_orderstatus when 'F' then o_orderkey % 2 when 'O' then 1 else null end as int),
               case when o_orderpriority = '1-URGENT' then 'deadline_resolved'
                    when o_orderpriority = '2-HIGH' then 'event_resolved'
                    when o_orderpriority = '5-LOW' then null else 'unclassifiable' end,
               cast(round(o_totalprice, 2) as decimal(20,6))
        from orders
      ) u"""
    # quotes of every minute that was traded, of the whole first hour after opening, and around the times that news may be dated to
    places = ([(d.shift("t_open", str(m * 60 + 300)), m) for m in (0, 20, 55)]
              + [(d.shift("t_resolve", f"-(num % 96) * 3600 - 1800 * {tier} - {lead * 60}"), k)
                 for tier in (1, 2) for k, lead in enumerate((0, 1, 3, 31, 121, 361, 1441, 10081), 3)])
    asked = " union all ".join(f"select num, market_id, {ts}{' as ts' * (i < 3)}, {place}{' as place' * (i < 3)} from markets where {{0}}"
                               for i, (ts, place) in enumerate(places))
    quoted = "t_resolve is not null and category <> 'other' and outcome is not null and resolution_type <> 'unclassifiable' and (market_id in (select market_id from trades) or num % 50 = 7)"
    v["quoted"] = f"""
      select num, market_id, ts, place, row_number() over (partition by market_id, ts order by place) as rn from (
        select num, market_id, date_trunc('minute', ts) as ts, place from ({asked.replace('{0}', quoted)}) a) b"""
    v["prices"] = """
      select market_id, ts, price as mid_price from (
        select market_id, ts, price, row_number() over (partition by market_id, ts order by kind, seen, id) as rn from (
          select t.market_id, date_trunc('minute', t.ts) as ts, t.price, 0 as kind, t.ts as seen, t.event_id as id
          from trades t join markets m on m.market_id = t.market_id
          where m.category <> 'other'
          union all
          select market_id, ts, cast(cast(1500 + (num * 37 + place * 311) % 7000 as decimal(10,0)) * 0.0001 as decimal(8,6)), 1, ts, num
          from quoted where rn = 1) u) q
      where rn = 1"""
    if d is SPARK:
        # all places of a market from one scan and one test; traded markets once each, not once per trade
        once = quoted.replace("(select market_id from trades)", "(select distinct market_id from trades)")
        v["quoted"] = f"""
      select num, market_id, ts, place, row_number() over (partition by market_id, ts order by place) as rn from (
        select num, market_id, date_trunc('minute', a.ts) as ts, a.place
        from (select num, market_id, t_open, t_resolve from markets where {once}) k
        lateral view inline(array({', '.join(f'struct({ts} as ts, {place} as place)' for ts, place in places)})) a as ts, place) b"""
        v["prices"] = v["prices"].replace("from trades t join markets m on m.market_id = t.market_id", """from trades t join (
            select distinct market_id, category from markets where market_id in (select distinct market_id from trades)) m on m.market_id = t.market_id""")
    tiers = " union all ".join(
        f"""select num, market_id, {i} as tier, t_resolve, category, outcome from markets
            where t_resolve is not null and {cond}"""
        for i, cond in ((1, "resolution_type = 'event_resolved'"), (2, "category <> 'other'"),
                        (3, "outcome = 1")))
    v["news"] = f"""
      select num, market_id, tier, {d.shift('t_resolve', '-(num % 96) * 3600 - 1800 * tier')} as t_news,
             cast(0.50 + ((num + tier) % 5) * 0.1 as decimal(3,2)) as confidence,
             'https://www.site' || cast(num % 13 as string) || '.example.org/n/' || cast(num as string) as source_url,
             case when tier = 3 then 'proxy: resolve minus 24h'
                  when tier = 2 then 'wire match' else 'page date' end as notes,
             t_resolve as recovered_at
      from ({tiers}) n"""
    v["wallets"] = f"""
      select address, first_seen_venue_at,
             case when n % 3 = 0 then null else {d.shift('first_seen_venue_at', f'-(n % 400) * {DAY}')} end
               as first_seen_chain_at,
             {d.shift('first_seen_venue_at', f'(n % 20) * {DAY}')} as last_refreshed_at
      from (select address, cast(substring(address, 2) as bigint) as n, min(ts) as first_seen_venue_at
            from (select taker_address as address, ts from trades
                  union all select maker_address, ts from trades) a group by address) w"""
    v["runs"] = f"""
      select o_orderkey as run_id, o_orderpriority as collector, {market_key('o_custkey % 100')} as target,
             case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'running' end as status,
             cast(o_orderdate as timestamp) as started_at,
             {d.shift('o_orderdate', 'o_orderkey % 7200')} as finished_at,
             case when o_orderkey % 4 = 0 then 0 else o_orderkey % 1000 end as n_records,
             case when o_orderstatus = 'O' then 'timeout after ' || cast(o_custkey % 30 as string) || 's' end
               as error_message
      from orders"""
    v["transfers"] = """
      select l_orderkey, l_linenumber,
             case when l_linenumber % 2 = 0 then 'W' else 'w' end || cast(l_suppkey as string) as to_address,
             case when l_linenumber % 3 = 0 then '0xA' else '0xa' end || cast(l_partkey % 50 as string)
               as from_address,
             cast(round(l_extendedprice * 1000000) as bigint) as value_units, cast(l_shipdate as timestamp) as ts
      from lineitem"""
    v["population"] = f"""
      select o_orderkey as num, {market_key('o_orderkey', 'o')} as market_id,
             {_pick('o_orderkey % 12', QUESTIONS)} as question,
             case o_orderpriority when '1-URGENT' then 'military_geopolitics'
                  when '2-HIGH' then 'corporate_disclosure' else 'regulatory_decision' end as category,
             case o_orderstatus when 'F' then 'regulatory_decision_formal'
                  when 'O' then 'regulatory_decision_announcement' else null end as subcategory,
             case when o_orderdate < timestamp '1998-05-01 00:00:00' then 'pre_2024' else 'post_2024' end as period,
             case when o_custkey % 3 = 0 then 'deadline_resolved' when o_custkey % 3 = 1 then 'event_resolved'
                  else 'unclassifiable' end as resolution_type,
             cast(o_orderdate as timestamp) as t_open,
             {d.shift('o_orderdate', '(1 + (o_orderkey * 37 % 400)) * 21600 + 3600')} as t_resolve,
             {d.shift('o_orderdate', '(1 + (o_orderkey * 37 % 400)) * 21600')} as t_event,
             (1 + (o_orderkey * 37 % 400)) * 0.25e0 as tau_days,
             0.5e0 + (o_orderkey % 6) * 0.1e0 as t_event_confidence,
             round(o_totalprice, 2) as volume,
             round(0.05e0 + (o_custkey % 90) * 0.01e0, 6) as p_open,
             round(0.05e0 + (o_orderkey % 90) * 0.01e0, 6) as p_event,
             cast(o_orderkey % 2 as int) as p_resolve,
             round(o_totalprice / 170000e0 - 1.5e0, 6) as ils_dl,
             case when o_orderkey % 4 = 0 then null else round(o_totalprice / 170000e0 - 1.48e0, 6) end as ils_dl_30min,
             case when o_orderkey % 5 = 0 then null else round(o_totalprice / 170000e0 - 1.45e0, 6) end as ils_dl_2h,
             case when o_orderkey % 6 = 0 then null
                  else round(o_totalprice / 170000e0 - 1.5e0 + (o_custkey % 10) * 0.05e0, 6) end as ils_dl_6h,
             case when o_orderkey % 7 = 0 then null
                  else round(o_totalprice / 190000e0 - 1.5e0 + (o_custkey % 9) * 0.03e0, 6) end as ils_dl_24h,
             o_orderkey % 10 <> 0 as in_scope,
             case when o_orderkey % 10 = 0 then 'no_quote_coverage' else '' end as exclusion_reason
      from orders"""
    flags = ", ".join([
        "case when o_custkey % 4 = 0 then 't_event_recovered' end",
        "case when o_custkey % 9 = 0 then 'lookback_predates_topen' end",
        "case when o_orderkey % 13 = 0 then 'low_information_market' end",
        "case when o_orderkey % 3 = 0 then 'window_7d_predates_topen' end"])
    v["scored"] = f"""
      select {market_key('o_orderkey', 'o')} as market_id,
             case o_custkey % 4 when 0 then 'military_geopolitics' when 1 then 'corporate_disclosure'
                  when 2 then 'regulatory_decision' else 'other' end as category,
             case when o_orderpriority = '1-URGENT' then 'deadline_resolved' else 'event_resolved' end as resolution_type,
             cast(o_orderkey % 2 as int) as p_resolve,
             case when o_orderkey % 13 = 0 then null
                  else cast(round(o_totalprice / 250000e0 - 0.5e0, 6) as decimal(10,6)) end as ils,
             cast(round((o_custkey % 101) / 100e0, 6) as decimal(8,6)) as volume_pre_share,
             cast(round(0.1e0 + (o_orderkey % 90) / 100e0, 6) as decimal(8,6)) as wallet_hhi,
             o_orderkey % 500 as n_trades_total, o_totalprice as volume,
             {d.compact.format(flags)} as flags,
             case when o_custkey % 2 = 0 then 'quotes' else 'trade_vwap' end as price_source,
             cast(o_orderdate as timestamp) as computed_at
      from orders"""
    v["case_lines"] = f"""
      select 'case-' || cast(o_custkey as string) as case_id,
             '{{"case_id":"case-' || cast(o_custkey as string) || '","title":"Case of customer '
             || cast(o_custkey as string) || '","markets":[{{"market_id_prefix":"0xzz' || cast(o_custkey as string)
             || '"}},{{"market_id_prefix":""}},{{"market_id":"' || min(p) || '"}},'
             || {d.collect.format("'{\"market_id_prefix\":\"' || p || '\"}'")} || ']}}' as line
      from (select o_custkey, substring({market_key('o_orderkey', 'o')}, 1, 10) as p from orders) c
      group by o_custkey"""
    v["answers"] = f"""
      select p_partkey as num, {market_key('p_partkey', 'o')} as market_id, tier,
             case tier when 1 then 'mini' when 2 then 'small' else 'large' end as model,
             500 + p_partkey % 900 as in_tokens, 40 + (p_partkey * tier) % 200 as out_tokens,
             (p_partkey + tier) % 3 as n_searches,
             case (p_partkey + tier) % 7
               when 0 then 'DATE: ' || day || '**' || chr(10) || 'SOURCES: Reuters, AP , none'
                           || chr(10) || 'REASON: first report.'
               when 1 then 'DATE: UNKNOWN' || chr(10) || 'SOURCES: none' || chr(10) || 'REASON: nothing found.'
               when 2 then 'DATE: ' || day || 'T10:30:00+02:00.' || chr(10) || 'SOURCES: none'
                           || chr(10) || 'REASON: agency note.'
               when 3 then '```json' || chr(10) || '{{"T_event":"' || day || 'T08:15:00Z","confidence":0.'
                           || cast(p_partkey % 10 as string)
                           || ',"sources":["https://a.example.com/1","https://b.example.com/2"],"n_sources":2,"reasoning":"ok"}}'
                           || chr(10) || '```'
               when 4 then 'Answer: {{"T_event":"' || day || '","confidence":0.9,"sources":["https://a.example.com/1"],"reasoning":"plain"}} done'
               when 5 then '{{"T_event":null,"confidence":0.2,"sources":[],"n_sources":0,"reasoning":"unclear"}}'
               else '{{"T_event":"' || day || ' broken' end as text
      from (select p_partkey, tier,
                   substring({d.iso.format(d.shift(T0, f'(p_partkey % 300) * {DAY} + tier * {DAY}'))}, 1, 10) as day
            from part, (select 1 as tier union all select 2 union all select 3) t) a"""
    v["wires"] = f"""
      select doc_id, {d.shift(T0, '(doc_id * 7919 % 43200) * 60')} as ts,
             {_pick('n_chars % 8', ['MILITARY;UKRAINE_WAR', 'TECH_LAUNCH;OPENAI', 'HEALTH_APPROVE;DRUG',
                                    'SPORT_FINALS;LAKERS', 'CRYPTO;BITCOIN_PRICE', 'SENATE_VOTE;TAX',
                                    'IRAN_STRIKES', 'GENERAL'])} as themes,
             'https://wire.example.net/' || cast(doc_id as string) as url, source as publisher
      from documents"""
    meta = f"""case page_id % 6
        when 0 then '<script type="application/ld+json">{{"@type":"NewsArticle","datePublished":"' || iso || '"}}</script>'
        when 1 then '<meta property="article:published_time" content="' || iso || '">'
        when 2 then '<meta content="' || substring(iso, 1, 10) || '" name="pubdate">'
        when 3 then '<time datetime="' || iso || '">then</time>'
        when 4 then '<script type="application/ld+json">[{{"dateModified":"' || substring(iso, 1, 19) || '+02:00"}}]</script>'
        else '<meta name="author" content="x">' end"""
    v["articles"] = f"""
      select page_id, url, html_in as html from (
        select page_id, url, replace(html, '</head>', {meta} || '</head>') as html_in
        from (select page_id, url, html,
                     {d.iso.format(d.shift(T0, '(page_id * 7919 % 43200) * 60'))} as iso from pages) p) q"""
    v["raw_markets"] = f"""
      select num as ingest_no, '{{' ||
             case when num % 9 = 0 then '"id":"' else '"conditionId":"' end || market_id || '",' ||
             '"question":"' || question || '",' ||
             case when description is null then '' else '"description":"' || description || '",' end ||
             case when num % 8 = 0 then '"startDate":"' else '"createdAt":"' end || {d.iso.format('t_open')} || '",' ||
             '"endDate":"' || {d.iso.format('end_date')} || '",' ||
             case when t_resolve is null then '' else '"closedTime":"' || {d.iso.format('t_resolve')} || '",' end ||
             '"volume":"' || cast(volume as string) || '","liquidity":"' || cast(liquidity as string) || '",' ||
             '"slug":"' || slug || '","groupItemTitle":"' || category_raw || '",' ||
             case when num % 5 = 0 then ''
                  else '"events":[{{"id":"' || event_group || '","title":"' || category_raw || ' event","negRisk":'
                       || case when neg_risk then 'true' else 'false' end || '}}],' end ||
             '"clobTokenIds":"[{d.bs}"1' || cast(num as string) || '{d.bs}",{d.bs}"2' || cast(num as string) || '{d.bs}"]",' ||
             case when outcome is null then '"outcomePrices":"[{d.bs}"0.5{d.bs}",{d.bs}"0.5{d.bs}"]"'
                  when num % 10 = 3 then '"outcomePrices":[' || case when outcome = 1 then '"1","0"' else '"0","1"' end || ']'
                  when outcome = 1 then '"outcomePrices":"[{d.bs}"1{d.bs}",{d.bs}"0{d.bs}"]"'
                  else '"outcomePrices":"[{d.bs}"0.0005{d.bs}",{d.bs}"0.9995{d.bs}"]"' end ||
             ',"tags":["' || coalesce(category, 'none') || '","' || category_raw || '"]' || '}}' as line
      from markets
      union all
      select num + 1000000000, '{{"conditionId":"' || market_id || '","question":"late copy"}}'
      from markets where category_raw = 'World'"""
    v["raw_quotes"] = f"""
      select event_id as ingest_no, market_id,
             '{{"history":[{{"t":' || cast(cast(floor({d.us.format('ts')} / 1000000) as bigint) as string) || ',"p":'
             || cast(price as string) || '}},{{"t":'
             || cast(cast(floor({d.us.format('ts')} / 1000000) as bigint) + 30 as string)
             || ',"p":0.5}}]}}' as line
      from trades"""
    v["raw_fills"] = f"""
      select event_id as ingest_no, market_id, cast(floor({d.us.format('ts')} / 1000000) as bigint) as sec,
             '{{"id":"' || case event_id % 4
                 when 0 then tx_hash || '_0x' || md5('o' || cast(event_id as string)) || md5('p' || cast(event_id as string))
                 when 1 then tx_hash || '-' || cast(event_id % 40 as string)
                 when 2 then cast(3000000000 + event_id as string)
                 else 'tx_' || 'ord' || cast(event_id as string) end
             || '","timestamp":"' || cast(cast(floor({d.us.format('ts')} / 1000000) as bigint) as string)
             || '","transactionHash":"' || tx_hash || '","maker":{{"id":"' || upper(maker_address)
             || '"}},"taker":{{"id":"' || upper(taker_address) || '"}},"side":"'
             || case when side = 'BUY' then 'Buy' else 'Sell' end || '","size":"'
             || cast(cast(size_shares as bigint) * 1000000 as string) || '","price":"' || cast(price as string)
             || '"}}' as line
      from (select * from trades union all
            select t.* from trades t join ev e on e.event_id = t.event_id where e.event_type = 'purchase') f"""
    v["requests"] = f"""
      select num, lower(hex('q: title ' || cast(num as string) || ', market_id: ' || market_id
                 || ' see https://polymarket.com/e/' || cast(num as string)
                 || case when evidence_url is null then '' else ' and ' || evidence_url end)) as ancillary_hex,
             upper(proposer) as proposer,
             case when outcome is null then null when outcome = 1 then '1000000000000000000' else '0' end as resolved_price,
             cast(floor({d.us.format('t_resolve')} / 1000000) as bigint) as resolve_timestamp,
             outcome is not null as settled
      from markets where t_resolve is not null"""
    v["settle_logs"] = f"""
      select num, '0x' || lpad('', 64, '1') || lpad('', 64, '0')
             || lpad('a0', 64, '0')
             || case when outcome = 1 then lpad('de0b6b3a7640000', 64, '0')
                     when outcome = 0 then lpad('', 64, '0') else lpad('', 64, 'f') end
             || lpad('', 64, '0') || lpad(lower(hex(cast(length(txt) as bigint))), 64, '0')
             || lower(hex(txt)) || lpad('', cast(64 - (length(txt) * 2) % 64 as int), '0') as data,
             '0x' || lpad('', 24, '0') || md5(proposer) || substring(md5(market_id), 1, 8) as topic2
      from (select num, outcome, proposer, market_id,
                   'res_data for ' || market_id || ' num ' || cast(num as string) as txt from markets
            where t_resolve is not null) s"""
    v["checkpoints"] = f"""
      select o_orderkey as line_no, case o_orderkey % 8
               when 0 then '{{"market_id":"' || mid || '","t_eve'
               when 1 then 'not json'
               when 2 then '{{"market_id":"' || mid || '","status":"failed","t_event":null,"confidence":0.0}}'
               else '{{"market_id":"' || mid || '","status":"ok","t_event":"' || {d.iso.format('o_orderdate')}
                    || '","confidence":0.' || cast(o_orderkey % 10 as string) || ',"provider":"p'
                    || cast(o_custkey % 3 as string) || '","estimated_cost_usd":0.0'
                    || cast(1 + o_custkey % 9 as string) || '}}' end as line
      from (select o_orderkey, o_custkey, o_orderdate,
                   {market_key('o_custkey', 'o')} as mid from orders) c"""
    return v


_WORD = re.compile(r"[a-z_]+")


def _needs(sql: str, names: set[str]) -> set[str]:
    return set(_WORD.findall(sql)) & names


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the adapter views it uses, as CTEs."""
    texts = view_sql(DUCK)
    names = set(texts)
    need, todo = set(), _needs(sql, names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo |= _needs(texts[n], names) - need
    ctes = [f"{n} as ({texts[n]})" for n in texts if n in need]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + (",\n" if ctes else "") + body[5:]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


_landed: dict[tuple[str, str, str], str] = {}
_histories: dict[tuple[str, str], object] = {}
_INLINE = {"ev"}


class Views:
    """Adapter tables over one data folder.

    They stand for stored tables, so each one is written once per session, on first use, below the
    stage folder, and read from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        ensure_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def _texts(self) -> dict[str, str]:
        return view_sql(SPARK)

    def table(self, name: str) -> DataFrame:
        """A given table; one that comes as fewer splits than there are cores is spread over them."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def _land(self, name: str, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _landed:
            path = f"{stage_folder(self.spark)}/{name}"
            df.write.parquet(path)
            _landed[key] = path
        return self.spark.read.schema(df.schema).parquet(_landed[key])

    @property
    def history(self):
        """The minute bars of prices and trades, stored once per session like the tables themselves."""
        from tidemark.operators.series import store_history
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _histories:
            _histories[key] = store_history(self.prices, self.trades)
        return _histories[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            text = self._texts.get(name)
            if text is None:
                if name not in BASE_TABLES:
                    raise AttributeError(name)
                self._made[name] = self.table(name)
            else:
                used = _needs(text, set(self._texts) | set(BASE_TABLES)) - {name}
                args = {n: getattr(self, n) for n in used if re.search(rf"(from|join|,)\s+{n}\b", text)}
                for n in args:
                    text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
                # braces of JSON text must survive the DataFrame formatter
                text = _escape_braces(text, set(args))
                df = self.spark.sql(text, **args)
                self._made[name] = df if name in _INLINE else self._land(name, df)
        return self._made[name]


def _escape_braces(text: str, names: set[str]) -> str:
    marks = {f"{{{n}}}": f"\0{n}\0" for n in names}
    for k, m in marks.items():
        text = text.replace(k, m)
    text = text.replace("{", "{{").replace("}", "}}")
    for k, m in marks.items():
        text = text.replace(m, k)
    return text

"""Raw payloads to tables, files and ledgers."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.texts import _LOG_INDEX, _OUTCOME, _TAIL
from tidemark.operators import audits as au
from tidemark.plans import population as pop
from tidemark.session import stage_folder
from tidemark.sources import files, ingest
from tidemark.sources.stored import BUCKET, Stored, bucket_of, week_of
from tidemark.sources.upsert import upsert

_MARKET_COLS = "market_id question description category_raw t_open:t end_date:t t_resolve:t outcome:l volume:d liquidity:d slug yes_token"


@query("load_markets_raw", _MARKET_COLS, f"""
    with r as (select *, coalesce(nullif(line->>'$.conditionId', ''), line->>'$.id') as market_id from raw_markets),
    f as (select *, row_number() over (partition by market_id order by ingest_no) as rn from r where market_id is not null)
    select market_id, coalesce(line->>'$.question', '') as question, line->>'$.description' as description,
      coalesce(nullif(line->>'$.events[0].title', ''), line->>'$.groupItemTitle', '') as category_raw,
      try_cast(coalesce(line->>'$.createdAt', line->>'$.startDate') as timestamp) as t_open, try_cast(line->>'$.endDate' as timestamp) as end_date,
      try_cast(line->>'$.closedTime' as timestamp) as t_resolve, {_OUTCOME} as outcome, (line->>'$.volume')::decimal(20,6) as volume,
      (line->>'$.liquidity')::decimal(20,6) as liquidity, line->>'$.slug' as slug, (line->>'$.clobTokenIds')->>'$[1]' as yes_token
    from f where rn = 1""")
def load_markets_raw(v):
    return ingest.markets(v.raw_markets)


_QUOTES = """q as (select ingest_no, market_id, unnest([0, 1]) as pos, line from raw_quotes),
    e as (select ingest_no, pos, market_id, date_trunc('minute', make_timestamp((line->>('$.history[' || pos || '].t'))::bigint * 1000000)) as ts,
          (line->>('$.history[' || pos || '].p'))::decimal(8,6) as mid_price from q),
    fresh as (select market_id, ts, mid_price from (select *, row_number() over (partition by market_id, ts order by ingest_no, pos) as rn from e) where rn = 1)"""


@query("load_prices_raw", "market_id ts:t mid_price:d", "with " + _QUOTES + " select * from fresh")
def load_prices_raw(v):
    return ingest.quotes(v.raw_quotes)


@query("upsert_prices", "market_id ts:t mid_price:d", "with " + _QUOTES + """
    select coalesce(f.market_id, p.market_id) as market_id, coalesce(f.ts, p.ts) as ts,
      case when f.market_id is not null then f.mid_price else p.mid_price + 0.5 end as mid_price
    from fresh f full join prices p on p.market_id = f.market_id and p.ts = f.ts""")
def upsert_prices(v):
    old = v.prices.select("market_id", "ts", (F.col("mid_price") + 0.5).alias("mid_price"))
    return upsert(old, ingest.quotes(v.raw_quotes), ["market_id", "ts"])


_FILL_COLS = "market_id tx_hash log_index:l ts:t taker_address maker_address side size_shares:d price:d notional_usdc:d outcome_index:l"
_FILLS = """f as (select ingest_no, market_id, line->>'$.transactionHash' as tx_hash, {idx} as log_index,
      make_timestamp((line->>'$.timestamp')::bigint * 1000000) as ts, lower(line->>'$.taker.id') as taker_address, lower(line->>'$.maker.id') as maker_address,
      case when lower(line->>'$.side') = 'buy' then 'BUY' else 'SELL' end as side, (line->>'$.size')::bigint / 1000000.0::double as size_shares,
      (line->>'$.price')::decimal(8,6) as price from (select *, line->>'$.id' as id from raw_fills)),
    loaded as (select *, round(size_shares * price::double, 6) as notional_usdc, 1 as outcome_index from (select *, row_number() over (partition by tx_hash, log_index
      order by ingest_no) as rn from f) where rn = 1)"""
_ALT = _TAIL.format("md5(concat_ws(':', line->>'$.transactionHash', lower(line->>'$.taker.id'), line->>'$.size', line->>'$.price', line->>'$.timestamp'))")


@query("load_trades_raw", _FILL_COLS, "with " + _FILLS.replace("{idx}", _LOG_INDEX) + " select * from loaded")
def load_trades_raw(v):
    return ingest.fills(v.raw_fills)


@query("load_trades_alt", _FILL_COLS, "with " + _FILLS.replace("{idx}", _ALT) + " select * from loaded")
def load_trades_alt(v):
    return ingest.alternate_fills(v.raw_fills)


@query("load_new_trades", "tx_hash log_index:l", "with " + _FILLS.replace("{idx}", _LOG_INDEX) + """
    select tx_hash, log_index from loaded l where not exists (select 1 from trades t where t.tx_hash = l.tx_hash and t.log_index = l.log_index)""")
def load_new_trades(v):
    return ingest.new_fills(ingest.fills(v.raw_fills), v.trades)


_RESOLVED = """
    r as (select *, decode(unhex(ancillary_hex)) as txt from requests where settled),
    u as (select *, regexp_extract_all(txt, 'https?://[^\\s,"'']+') as urls, regexp_extract(txt, '0x[0-9a-f]{64}') as market_id from r),
    res as (select market_id, make_timestamp(resolve_timestamp * 1000000) as t_resolve, case when resolved_price::double / 1e18 >= 0.5 then 1 else 0 end as outcome,
      coalesce(list_filter(urls, lambda x: not contains(x, 'polymarket.com'))[1], urls[1]) as evidence_url, lower(proposer) as proposer
    from u where market_id in (select market_id from markets))"""


@query("load_resolutions", "market_id t_resolve:t outcome:l evidence_url proposer", "with " + _RESOLVED + " select * from res")
def load_resolutions(v):
    return ingest.resolutions(v.requests, v.markets)


@query("upsert_resolutions", "market_id question t_resolve:t outcome:l evidence_url proposer", "with " + _RESOLVED + """
    select m.market_id, question, case when r.market_id is not null then r.t_resolve else m.t_resolve end as t_resolve,
      case when r.market_id is not null then r.outcome else m.outcome end as outcome, case when r.market_id is not null then r.evidence_url else m.evidence_url end as evidence_url,
      case when r.market_id is not null then r.proposer else m.proposer end as proposer from markets m left join res r on r.market_id = m.market_id""")
def upsert_resolutions(v):
    """Four columns of stored markets are overwritten; a market that is not stored would get an empty question."""
    cols = ["market_id", "question", "t_resolve", "outcome", "evidence_url", "proposer"]
    table = Stored(v.spark, stage_folder(v.spark) + "/markets", ("market_id",), bucket_of("market_id", 8), BUCKET).create(v.markets.select(cols))
    new = ingest.resolutions(v.requests, v.markets).withColumn("question", F.lit("")).select(cols)
    table.merge(new, {c: "overwrite" for c in cols[2:]})
    return table.rows()


@query("merge_stored_prices", "market_id ts:t mid_price:d", "with " + _QUOTES + """,
    picked as (select * from fresh where ts >= timestamp '2024-01-15 00:00:00' and ts < timestamp '2024-01-18 00:00:00')
    select coalesce(f.market_id, p.market_id) as market_id, coalesce(f.ts, p.ts) as ts,
      case when f.market_id is not null then f.mid_price else p.mid_price + 0.5 end as mid_price
    from picked f full join prices p on p.market_id = f.market_id and p.ts = f.ts""")
def merge_stored_prices(v):
    """Three days of quotes merged into prices stored by week: other weeks are neither read nor written."""
    old = v.prices.select("market_id", "ts", (F.col("mid_price") + 0.5).cast("decimal(8,6)").alias("mid_price"))
    table = Stored(v.spark, stage_folder(v.spark) + "/prices", ("market_id", "ts"), week_of()).create(old)
    table.merge(ingest.quotes(v.raw_quotes).where("ts >= timestamp '2024-01-15 00:00:00' and ts < timestamp '2024-01-18 00:00:00'"))
    return table.rows()


@query("insert_stored_trades", "tx_hash log_index:l ts:t price:d", "with " + _FILLS.replace("{idx}", _LOG_INDEX) + """
    select tx_hash, log_index, ts, price from trades where event_id % 3 > 0
    union all select tx_hash, log_index, ts, price from loaded l where not exists (select 1 from trades t where t.event_id % 3 > 0 and t.tx_hash = l.tx_hash and t.log_index = l.log_index)""")
def insert_stored_trades(v):
    """Fills beside the trades that are stored, by a bucket of the hash; stored ones stay as they are and only new files are written."""
    cols = ["tx_hash", "log_index", "ts", "price"]
    table = Stored(v.spark, stage_folder(v.spark) + "/trades", ("tx_hash", "log_index"), bucket_of("tx_hash", 8), BUCKET).create(v.trades.where("event_id % 3 > 0").select(cols).withColumn("log_index", F.col("log_index").cast("bigint")))
    table.merge(ingest.fills(v.raw_fills).select(cols), "do_nothing")
    return table.rows()


@query("load_transfers", "address n_transfers:l total_usdc:d first_seen_chain_at:t", """
    select lower(to_address) as address, count(*) as n_transfers, sum(value_units::decimal(30,0) * 0.000001) as total_usdc, min(ts) as first_seen_chain_at
    from transfers group by all""")
def load_transfers(v):
    return ingest.incoming_transfers(v.transfers)


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query("typology_export", "market_id question description category resolution_type resolution_outcome:l volume_total_usdc:d created_at closed_at resolved_at n_trades_in_db:l", f"""
    select m.market_id, question, description, category, resolution_type, outcome as resolution_outcome, volume as volume_total_usdc,
      {_ISO.format('t_open')} as created_at, {_ISO.format('end_date')} as closed_at, {_ISO.format('t_resolve')} as resolved_at, coalesce(c.n, 0) as n_trades_in_db
    from markets m left join (select market_id, count(*) as n from trades group by all) c on c.market_id = m.market_id
    where t_open is null or t_open <= timestamp '2024-01-04 00:00:00'""")
def typology_export(v):
    return files.typology_rows(v.markets, au.per_market(v.trades, "n_trades"), F.expr("timestamp '2024-01-04 00:00:00'"))


_GOOD = """good as (select line_no, line->>'$.market_id' as market_id, line->>'$.status' as status, try_cast(line->>'$.t_event' as timestamp) as t_event,
      (line->>'$.confidence')::double as confidence, line->>'$.provider' as provider from (select * from checkpoints where json_valid(line)))"""


@query("read_tolerant_jsonl", "market_id line_no:l status t_event:t confidence:d provider", "with " + _GOOD + """
    select * from (select *, row_number() over (partition by market_id order by line_no desc) as rn from good where t_event is not null and confidence > 0) where rn = 1""")
def read_tolerant_jsonl(v):
    return files.tolerant_records(v.checkpoints, F.expr("t_event is not null and confidence > 0"))


@query("resume_remaining", "market_id", "with " + _GOOD + """
    select market_id from population p where resolution_type <> 'unclassifiable' and not exists (select 1 from good g where g.market_id = p.market_id and g.status = 'ok')""")
def resume_remaining(v):
    done = files.tolerant_records(v.checkpoints, F.expr("status = 'ok'"))
    return files.remaining(v.population.where("resolution_type <> 'unclassifiable'").select("market_id"), done)


@query("flatten_cases", "case_id title prefix", """
    select line->>'$.case_id' as case_id, line->>'$.title' as title,
      coalesce(line->>('$.markets[' || i || '].market_id_prefix'), line->>('$.markets[' || i || '].market_id'), '') as prefix
    from (select line, unnest(range(json_array_length(line, '$.markets')::bigint)) as i from case_lines)""")
def flatten_cases(v):
    return pop.flatten_cases(v.case_lines)


@query("tag_counts", "tag n:l geopolitical:l", """
    with t as (select m.category, unnest(from_json(r.line->'$.tags', '["VARCHAR"]')) as tag from raw_markets r join markets m
       on m.market_id = coalesce(r.line->>'$.conditionId', r.line->>'$.id') where json_type(r.line, '$.tags') = 'ARRAY')
    select tag, count(*) as n, count(*) filter (category = 'military_geopolitics') as geopolitical from t group by tag""")
def tag_counts(v):
    return au.tag_counts(_raw_with_market(v))


def _raw_with_market(v):
    mid = F.coalesce(F.get_json_object("line", "$.conditionId"), F.get_json_object("line", "$.id"))
    return v.raw_markets.withColumn("market_id", mid).join(v.markets.select("market_id", "category", "t_resolve"), "market_id")


@query("json_field_audit", "resolved_total:l resolved_with_closed_time:l resolved_no_closed_time:l unresolved_with_closed_time:l with_closed_time:l "
       "with_start_date:l exclusive_events:l", """
    with x as (select m.t_resolve is not null as r, r.line->>'$.closedTime' is not null as c, r.line from raw_markets r join markets m
       on m.market_id = coalesce(r.line->>'$.conditionId', r.line->>'$.id'))
    select count(*) filter (r) as resolved_total, count(*) filter (r and c) as resolved_with_closed_time, count(*) filter (r and not c) as resolved_no_closed_time,
      count(*) filter (not r and c) as unresolved_with_closed_time, count(*) filter (c) as with_closed_time,
      count(*) filter (line->>'$.startDate' is not null) as with_start_date, count(*) filter (line->>'$.events[0].negRisk' = 'true') as exclusive_events from x""")
def json_field_audit(v):
    return au.json_field_audit(_raw_with_market(v))


@query("report_sinks", "collector status runs:l total_records:l", "select collector, status, count(*) as runs, sum(n_records) as total_records from runs group by all")
def report_sinks(v):
    path = stage_folder(v.spark) + "/report"
    files.write_report(au.run_stats(v.runs).select("collector", "status", "runs", "total_records"), path, "csv")
    return v.spark.read.schema("collector string, status string, runs bigint, total_records bigint").option("header", True).csv(path)


@query("run_ledger_append", "collector started_at:t status target n_records:l", """
    select collector, started_at, status, target, n_records from runs union all select 'scoring', null, 'success', 'batch', 0""")
def run_ledger_append(v):
    path = stage_folder(v.spark) + "/ledger"
    v.runs.select("collector", "started_at", "finished_at", "status", "target", "n_records", "error_message").write.mode("append").parquet(path)
    files.append_run(v.spark, path, {"collector": "scoring", "status": "success", "target": "batch", "n_records": 0})
    return v.spark.read.parquet(path)

"""Streaming steps run to completion over the whole trade table, compared with their batch forms."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.session import stage_folder
from tidemark.streaming import twins as st
from tidemark.streaming.segments import Segments

_TRADE = ["market_id", "tx_hash", "log_index", "ts", "taker_address", "maker_address", "price", "size_shares", "notional_usdc"]


#: batches of a stream that is read from files, and rows of a file beyond which a batch gets more of them
BATCHES, PER_FILE = 4, 1_000_000


def _stream(v, df):
    """Write a table in event-time order as files and read it back as a stream, in a few batches."""
    src = stage_folder(v.spark) + "/src"
    files = max(1, -(-df.count() // (BATCHES * PER_FILE)))
    order = ["ts", *[c for c in ("tx_hash", "log_index") if c in df.columns]]
    df.repartitionByRange(BATCHES * files, *order).sortWithinPartitions("ts").write.parquet(src)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(src), stage_folder(v.spark)


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _arrive(v, df, arrival, steps):
    """Append a table to the source folder one arrival after another, and run each step (writable stream, checkpoint) over what is new.

    Every arrival is a run of its own, so each step goes on from its checkpoint, with its state and watermark.
    """
    src = stage_folder(v.spark) + "/src"
    df = df.withColumn("_arrival", arrival)
    for a in range(ARRIVALS):
        df.where(F.col("_arrival") == a).drop("_arrival").write.mode("append").parquet(src)
        for step in steps:
            _finish(step(src))


#: arrivals of the trade streams, days of a regular arrival; every 50th trade comes one arrival later
ARRIVALS, SPAN, LATENESS = 4, 8, "1 day"
_BUCKET = "({us} - {start}) {div} (%d * 86400000000)" % SPAN
_LATER = " + (case when event_id % 50 = 7 then 1 else 0 end)"
_ARRIVED = f"""
    arrived as (select *, cast(least({ARRIVALS - 1}, {_BUCKET.format(us='epoch_us(ts)', start="epoch_us(timestamp '2024-01-01 00:00:00')", div='//')}{_LATER}) as int) as b from trades),
    marks as (select b, (select max(ts) from arrived e where e.b < a.b) - interval 1 day as mark from (select distinct b from arrived) a),
    sides as (select a.*, coalesce(date_trunc('minute', ts) + interval 1 minute <= mark, false) as late from arrived a join marks using (b))"""


def _landed(v):
    """The trades through landing and closed minutes, arrival after arrival: the landing, the sink of closed sums, and the rows' schema."""
    t, out = v.trades.select("event_id", *_TRADE), stage_folder(v.spark)
    landing = st.Landing(v.spark, out + "/land", LATENESS).create()
    arrival = F.expr(f"cast(least({ARRIVALS - 1}, " + _BUCKET.format(us="unix_micros(ts)", start="unix_micros(timestamp '2024-01-01 00:00:00')", div="div") + f"{_LATER}) as int)")

    def land(src):
        s = v.spark.readStream.schema(t.schema).parquet(src)
        return st.run_merge(s, landing.write, out + "/c1")

    def close(src):
        return st.run_to_files(st.minute_sums(landing.on_time(t.schema), LATENESS), out + "/closed", out + "/c2")

    _arrive(v, t, arrival, [land, close])
    return landing, v.spark.read.parquet(out + "/closed"), t.schema


@query("stream_trade_dedupe", "tx_hash log_index:l n:l", "select tx_hash, log_index, 1 as n from trades")
def stream_trade_dedupe(v):
    twice = v.trades.select(*_TRADE).unionByName(v.trades.select(*_TRADE))
    s, out = _stream(v, twice)
    # files hold disjoint time ranges but arrive in any order: keep state for the whole span
    _finish(st.run_to_files(st.dedupe_trades(s, "60 days"), out + "/t", out + "/c"))
    return v.spark.read.parquet(out + "/t").groupBy("tx_hash", "log_index").agg(F.count("*").alias("n"))


@query("stream_minute_vwap", "market_id ts:t mid_price:d volume:d", """
    select market_id, date_trunc('minute', ts) as ts, sum(notional_usdc)::double / sum(size_shares)::double as mid_price, sum(notional_usdc) as volume
    from trades group by all""")
def stream_minute_vwap(v):
    landing, closed, schema = _landed(v)
    return st.all_minutes(closed, landing, schema)


@query("stream_closed_minutes", "market_id ts:t volume:d shares:d", "with " + _ARRIVED + """
    select market_id, date_trunc('minute', ts) as ts, sum(notional_usdc) as volume, sum(size_shares) as shares from sides
    where not late and date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from trades) - interval 1 day group by all""")
def stream_closed_minutes(v):
    return _landed(v)[1]


@query("stream_late_trades", "b:l tx_hash log_index:l ts:t", "with " + _ARRIVED + " select b, tx_hash, log_index, ts from sides where late")
def stream_late_trades(v):
    landing, _, schema = _landed(v)
    return landing.rows(schema, True)


@query("stream_wallet_first_seen", "address first_seen:t", """
    select address, min(ts) as first_seen from (select taker_address as address, ts from trades union all select maker_address, ts from trades) group by all""")
def stream_wallet_first_seen(v):
    s, out = _stream(v, v.trades.select(*_TRADE))
    _finish(st.run_merge(s, st.first_seen_writer(out + "/t"), out + "/c"))
    return st.read_first_seen(v.spark, out + "/t")


_WRITES = """
    with q as (select event_id, market_id, date_trunc('minute', ts) as ts, price, 0 as b from trades
      union all select event_id, market_id, date_trunc('minute', ts), least(1, price + 0.1)::decimal(8,6), 1 from trades where event_id % 2 = 0
      union all select event_id, market_id, date_trunc('minute', ts), (price * 0.5)::decimal(8,6), 2 from trades where event_id % 3 = 0),
    firsts as (select market_id, ts, b, arg_min(price, event_id) as mid_price from q group by all)
    select market_id, ts, arg_max(mid_price, b) as mid_price from firsts group by all"""


def _rewritten(v):
    """Three batches that write the same minutes with other prices, the first two compacted in between."""
    q = v.trades.select(F.col("event_id").alias("ingest_no"), "market_id", F.date_trunc("minute", "ts").alias("ts"), F.col("price").alias("mid_price"))
    out = stage_folder(v.spark)
    table = Segments(v.spark, out + "/t", ("market_id", "ts"), "market_id string, ts timestamp, mid_price decimal(8,6)").create()
    writes = [q, q.where("ingest_no % 2 = 0").withColumn("mid_price", F.expr("cast(least(1, mid_price + 0.1) as decimal(8,6))")),
              q.where("ingest_no % 3 = 0").withColumn("mid_price", F.expr("cast(mid_price * 0.5 as decimal(8,6))"))]
    for k, rows in enumerate(writes):
        rows.write.mode("append").parquet(out + "/src")
        _finish(st.run_merge(v.spark.readStream.schema(q.schema).parquet(out + "/src"), st.quote_writer(table), out + "/c"))
        if k < 2:
            table.compact()
    return table


@query("stream_price_upsert", "market_id ts:t mid_price:d", _WRITES)
def stream_price_upsert(v):
    return _rewritten(v).read()


@query("stream_price_compacted", "market_id ts:t mid_price:d", _WRITES)
def stream_price_compacted(v):
    table = _rewritten(v)
    table.compact()
    return table.compacted()

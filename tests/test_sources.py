"""Merges, tolerant readers, sinks and streaming twins."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_scores import TRADES, at
from tidemark.operators import audits as au
from tidemark.operators.features import wallet_first_seen
from tidemark.operators.series import vwap_buckets
from tidemark.sources import files, ingest, stored
from tidemark.sources.upsert import keep_first, upsert
from tidemark.streaming import twins
from tidemark.streaming.segments import Segments


def _kv(spark, rows):
    return spark.createDataFrame(rows, "k string, a int, b string")


@pytest.mark.parametrize("policy, expected", [
    ("overwrite", {"x": (None, "n"), "y": (2, "o"), "z": (9, "n")}), ("coalesce", {"x": (1, "n"), "y": (2, "o"), "z": (9, "n")}),
    ("do_nothing", {"x": (1, "o"), "y": (2, "o"), "z": (9, "n")}), ({"b": "overwrite"}, {"x": (1, "n"), "y": (2, "o"), "z": (9, "n")}),
    ({"a": "least"}, {"x": (1, "o"), "y": (2, "o"), "z": (9, "n")})])
def test_upsert_policies(spark, policy, expected):
    old, new = _kv(spark, [("x", 1, "o"), ("y", 2, "o")]), _kv(spark, [("x", None, "n"), ("z", 9, "n")])
    assert {r["k"]: (r["a"], r["b"]) for r in upsert(old, new, ["k"], policy).collect()} == expected


def test_keep_first_with_a_hot_key(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = keep_first(df, ["k"], ["id"])
    assert got.where("k = 'hot'").collect()[0]["id"] == 0 and got.count() == df.select("k").distinct().count()


def test_tolerant_reader_and_resume(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"market_id":"a","status":"ok"}\n{"market_id":"a","st\nnot json\n\n{"status":"ok"}\n'
                 '{"market_id":"b","status":"failed"}\n{"market_id":"a","status":"failed","confidence":0.4}\n')
    lines = files.read_lines(spark, str(p))
    assert {r["market_id"]: r["status"] for r in files.tolerant_records(lines).collect()} == {"a": "failed", "b": "failed"}
    done = files.tolerant_records(lines, F.expr("status = 'ok'"))
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "market_id string")
    assert sorted(r[0] for r in files.remaining(todo, done).collect()) == ["b", "c"]


def test_lines_keep_the_order_of_files(spark, tmp_path):
    for k, n in enumerate([10, 4000, 300]):  # of unequal size, so that Spark packs them in another order
        (tmp_path / f"f{k}.jsonl").write_text("".join(f'{{"market_id":"m","status":"{k}-{i}"}}\n' for i in range(n)))
    lines = files.read_lines(spark, str(tmp_path))
    assert [r["status"] for r in files.tolerant_records(lines).collect()] == ["2-299"]
    names = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert names == [f'{{"market_id":"m","status":"{k}-{i}"}}' for k, n in enumerate([10, 4000, 300]) for i in range(n)]


def test_market_lines(spark):
    rows = [(2, '{"conditionId":"0x1","question":"later"}'),
            (1, '{"conditionId":"0x1","question":"Q","createdAt":"2025-01-01T00:00:00Z","outcomePrices":["1","0"],"clobTokenIds":"[\\"5\\",\\"6\\"]",'
                '"events":[{"title":""}],"groupItemTitle":"G","volume":12.5}'), (3, "broken"), (4, '{"id":"7","startDate":"2025-01-02T03:00:00+01:00"}')]
    got = {r["market_id"]: r for r in ingest.markets(spark.createDataFrame(rows, "ingest_no int, line string")).collect()}
    a = got["0x1"]
    assert (a["question"], a["outcome"], a["yes_token"], a["category_raw"], a["volume"]) == ("Q", 1, "6", "G", Decimal("12.500000"))
    assert got["7"]["t_open"] == datetime(2025, 1, 2, 2) and set(got) == {"0x1", "7"}


def test_payloads_are_parsed_once(spark):
    """Both encodings of lists, numbers for texts, missing and broken lines; one parse in the plan however many fields are read."""
    rows = [(1, '{"id":"a","outcomePrices":["0.999","0"],"clobTokenIds":["1","2"],"volume":1e3,"liquidity":"7","events":[]}'),
            (2, '{"id":"b","outcomePrices":"[\\"0\\",\\"1\\"]","clobTokenIds":"[\\"3\\"]","volume":"x","events":[{"title":"T","negRisk":true}],"closedTime":null}'),
            (3, '{"id":"c","outcomePrices":"[0.5"'), (4, ""), (5, None), (6, '["id"]'), (7, '{"id":5,"outcomePrices":"[0.5","question":"q"}')]
    raw = spark.createDataFrame(rows, "ingest_no int, line string")
    got = {r["market_id"]: r for r in ingest.markets(raw).collect()}
    assert set(got) == {"a", "b", "5"}
    assert [(got[k]["outcome"], got[k]["yes_token"], got[k]["volume"], got[k]["category_raw"]) for k in "ab5"] == [
        (1, "2", Decimal("1000.000000"), ""), (0, None, None, "T"), (None, None, None, "")]
    assert got["a"]["liquidity"] == Decimal("7.000000") and got["b"]["t_resolve"] is None
    plan = ingest.markets(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    audit = au.json_field_audit(raw.withColumn("t_resolve", F.lit(None).cast("timestamp"))).collect()[0]
    assert audit["exclusive_events"] == 1 and audit["with_closed_time"] == 0 and audit["resolved_total"] == 0


def test_sinks_round_trip(spark, tmp_path):
    df = _kv(spark, [("x", 1, "o"), ("y", None, "p")])
    for fmt in ("csv", "parquet", "json"):
        files.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sorted(spark.read.parquet(str(tmp_path / "parquet")).collect()) == sorted(df.collect())
    m = spark.createDataFrame([("m", "q", None, "c", "r", 1, Decimal("2.5"), at(0), None, None)],
                              "market_id string, question string, description string, category string, resolution_type string, outcome int, "
                              "volume decimal(20,6), t_open timestamp, end_date timestamp, t_resolve timestamp")
    rows = files.typology_rows(m, spark.createDataFrame([("m", 3)], "market_id string, n_trades bigint"), F.expr("timestamp '2030-01-01'"))
    files.write_typology(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t" / "parquet")).collect()[0]
    assert back["created_at"] == "2025-01-01T00:00:00Z" and back["n_trades_in_db"] == 3 and back["resolved_at"] is None


@pytest.fixture
def trades(spark):
    return spark.createDataFrame([
        ("m", at(i // 3), f"t{i}", 0, f"w{i % 4}", f"w{i % 5 + 2}", "BUY", 1, Decimal("0.5"), Decimal(i + 1), Decimal(i + 1) / 2) for i in range(60)], TRADES)


def _stream(spark, df, path, parts=3):
    df.repartitionByRange(parts, "ts").write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_merges_equal_batch(spark, trades, tmp_path):
    s = _stream(spark, trades, tmp_path / "src")
    q = twins.run_merge(s, twins.first_seen_writer(str(tmp_path / "w")), str(tmp_path / "cw"))
    q.awaitTermination()
    assert _rows(twins.read_first_seen(spark, str(tmp_path / "w"))) == _rows(wallet_first_seen(trades))


def test_merge_can_be_run_again(spark, trades, tmp_path):
    write = twins.first_seen_writer(str(tmp_path / "w"))
    a, b = trades.where("log_index = 0 and taker_address in ('w0', 'w1')"), trades
    for batch, i in ((a, 0), (b, 1), (b, 1)):
        write(batch, i)
    assert _rows(twins.read_first_seen(spark, str(tmp_path / "w"))) == _rows(wallet_first_seen(trades))


def test_segments_last_batch_wins_under_compaction(spark, tmp_path):
    q = lambda *rows: spark.createDataFrame(list(rows), "ingest_no int, market_id string, ts timestamp, mid_price double")
    table = Segments(spark, str(tmp_path / "q"), ("market_id", "ts"), "market_id string, ts timestamp, mid_price double").create()
    assert table.read().count() == 0 and table.compact() == 0
    write = twins.quote_writer(table)
    write(q((2, "m", at(0), 0.2), (1, "m", at(0), 0.1), (5, None, at(0), 0.7)), 0)
    write(q((3, "m", at(0), 0.3), (4, "m", at(1), 0.4)), 1)
    want = [("m", at(0), 0.3), ("m", at(1), 0.4)]
    rows = lambda df: sorted(tuple(r) for r in df.where("market_id is not null").collect())
    assert rows(table.read()) == want
    before = table.version()  # a reader that began now
    assert table.compact() == 1 and rows(table.compacted()) == want and table.batches(table.version()[1]) == []
    write(q((9, "m", at(1), 0.9), (8, "m", at(0), None)), 2)
    write(q((9, "m", at(1), 0.9), (8, "m", at(0), None)), 2)  # run again
    now = [("m", at(0), None), ("m", at(1), 0.9)]
    assert rows(table.read()) == rows(table.read(before)) == now and rows(table.compacted()) == want
    table.spark.range(1).write.parquet(f"{table.path}/log/b=3")  # a segment that is not whole yet
    assert rows(table.read()) == now and table.compact() == 2 and rows(table.compacted()) == now
    assert {p.removeprefix(table.path) for p in table.superseded(1)} == {"/base/v=0", "/base/v=1", "/log/b=0", "/log/b=1", "/log/b=2"}
    assert table.read().where("market_id is null").collect()[0]["mid_price"] == 0.7


def test_stream_dedupe(spark, trades, tmp_path):
    s = _stream(spark, trades.unionByName(trades), tmp_path / "src", 1)
    q = twins.run_to_files(twins.dedupe_trades(s), str(tmp_path / "d"), str(tmp_path / "cd"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 60


def test_closed_minutes_late_rows_and_open_minutes_equal_the_batch(spark, trades, tmp_path):
    """A watermark of ten minutes moves on with each arrival; a row that comes after its minute was closed is on the late side, once."""
    landing = twins.Landing(spark, str(tmp_path / "l"), "10 minutes").create()
    src, closed = str(tmp_path / "src"), str(tmp_path / "closed")
    minute = lambda a, b: trades.where((F.col("ts") >= F.lit(at(a))) & (F.col("ts") < F.lit(at(b))))
    late, slow = minute(1, 2).limit(1), minute(8, 9).limit(1)
    rest = trades.join(late.unionByName(slow), ["tx_hash"], "left_anti").select(trades.columns)
    cut = lambda a, b: rest.where((F.col("ts") >= F.lit(at(a))) & (F.col("ts") < F.lit(at(b))))
    sizes = []
    for rows in (cut(0, 7), cut(7, 14), cut(14, 20).unionByName(late).unionByName(slow)):  # one row behind the watermark at(13) - 10, one before it
        rows.coalesce(1).write.mode("append").parquet(src)
        twins.run_merge(spark.readStream.schema(trades.schema).parquet(src), landing.write, str(tmp_path / "c1")).awaitTermination()
        q = twins.run_to_files(twins.minute_sums(landing.on_time(trades.schema), "10 minutes"), closed, str(tmp_path / "c2"))
        q.awaitTermination()
        assert not q.exception() and all(op["numRowsDroppedByWatermark"] == 0 for p in q.recentProgress for op in p["stateOperators"])
        sizes.append(spark.read.parquet(closed).count() if landing.watermark() else 0)
    table = spark.read.parquet(closed)
    assert sizes == [0, 3, 9] and landing.late_count() == 1  # closed minutes only grow
    assert [(r.tx_hash, r.b) for r in landing.rows(trades.schema, True).collect()] == [(late.first()["tx_hash"], 2)]
    want = vwap_buckets(trades).select("market_id", "ts", "mid_price", "volume")
    assert _rows(twins.all_minutes(table, landing, trades.schema)) == _rows(want)
    before = _rows(landing.rows(trades.schema, False))
    landing.write(trades, 2)  # a batch that is whole is not written again
    assert _rows(landing.rows(trades.schema, False)) == before and landing.late_count() == 1


def _mtimes(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in sorted(path.rglob("*.parquet"))}


@pytest.mark.parametrize("policy", ["overwrite", "do_nothing", {"v": "greatest"}])
def test_merge_reads_and_writes_touched_weeks_only(spark, tmp_path, policy):
    weeks = lambda k: at(60 * 24 * 7 * k + 5)
    frame = lambda rows: spark.createDataFrame(rows, "market_id string, ts timestamp, v int")
    old = [(m, weeks(k), k) for m in ("a", "b", None) for k in range(6)]
    path = tmp_path / "facts"
    table = stored.Stored(spark, str(path), ("market_id", "ts"), stored.week_of()).create(frame(old))
    files = _mtimes(path)
    new = frame([("a", weeks(2), 1), ("a", at(60 * 24 * 7 * 2 + 9), 90), (None, weeks(3), 99)])
    plan = table.merged(new)._jdf.queryExecution().executedPlan().toString() if isinstance(policy, dict) else None
    assert plan is None or "PartitionFilters: [week" in plan.replace("isnotnull(week), ", "") or "week#" in plan.split("PartitionFilters")[1][:80]
    table.merge(new, policy)
    touched = {str(r[0]) for r in new.select(stored.week_of()).distinct().collect()}
    after = _mtimes(path)
    kept = {f: t for f, t in files.items() if f.split("/")[0].split("=")[1] not in touched}
    assert len(touched) == 2 and kept and all(after[f] == t for f, t in kept.items())
    want = {r[:2]: r[2] for r in old}
    for m, t, v in (tuple(r) for r in new.collect()):
        have = want.get((m, t))
        want[m, t] = v if have is None or policy == "overwrite" else have if policy == "do_nothing" else max(v, have)
    assert {(r.market_id, r.ts): r.v for r in table.rows().collect()} == want and table.rows().count() == len(want)
    table.merge(new, policy)  # once more changes nothing
    assert {(r.market_id, r.ts): r.v for r in table.rows().collect()} == want
    table.merge(new.limit(0), policy)
    assert sorted(r.v for r in table.between(weeks(1), weeks(2)).collect()) == sorted(v for (m, t), v in want.items() if weeks(1) <= t < weeks(2))


class _Session:
    """Just the settings that choose the stage folder."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_stages_go_below_the_named_folder():
    from tidemark.session import stage_folder
    a, b = (stage_folder(_Session("yarn", "hdfs:///shared/")) for _ in range(2))
    assert a.startswith("hdfs:///shared/tidemark-") and a != b
    with pytest.raises(ValueError):
        stage_folder(_Session("yarn"))


@pytest.mark.parametrize("policy", ["overwrite", "do_nothing"])
def test_merged_rows_take_the_types_of_the_table(spark, tmp_path, policy):
    table = stored.Stored(spark, str(tmp_path / "t"), ("k",), stored.bucket_of("k", 4), stored.BUCKET).create(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    for v in (3, 4):
        table.merge(spark.createDataFrame([(v, "c"), (v, "a")], "v bigint, k string"), policy)
    assert table.rows().schema["v"].dataType.simpleString() == "int"
    assert {r.k: r.v for r in table.rows().collect()} == ({"a": 4, "b": 2, "c": 4} if policy == "overwrite" else {"a": 1, "b": 2, "c": 3})
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        table.merge(spark.createDataFrame([(1 << 40, "d")], "v bigint, k string"), policy)


def test_stream_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.catalog import streams
    monkeypatch.setattr(streams, "PER_FILE", 50)
    trades = spark.range(0, 500, 1, 3).selectExpr(
        "'m' as market_id", "cast(id as string) as tx_hash", "0 as log_index", "timestamp_seconds(1704067200 + id div 300) as ts", "'a' as taker_address",
        "'b' as maker_address", "0.5 as price", "1.0 as size_shares", "0.5 as notional_usdc")
    folders = []
    folder = streams.stage_folder
    monkeypatch.setattr(streams, "stage_folder", lambda s: folders.append(folder(s)) or folders[-1])
    got = streams.stream_trade_dedupe(SimpleNamespace(spark=spark, trades=trades)).collect()
    assert len(got) == 500 and all(r["n"] == 1 for r in got)
    assert len(spark.read.parquet(folders[0] + "/src").inputFiles()) == 20  # 1000 rows: 5 files in each of the 4 batches


def test_answers_of_a_cascade_are_parsed_once(spark):
    from tidemark.plans import recovery
    rows = [("a", t, "mini", 100, 10, 0, f"DATE: 2024-01-0{t}\nSOURCES: {'Reuters' if t == 2 else 'none'}\nREASON: x") for t in (1, 2, 3)]
    rows += [("b", 1, "mini", 100, 10, 0, "DATE: UNKNOWN\nSOURCES: none\nREASON: x"), (None, 1, "mini", 100, 10, 0, "DATE: 2024-01-01\nSOURCES: AP\nREASON: x")]
    answers = spark.createDataFrame(rows, "market_id string, tier int, model string, in_tokens int, out_tokens int, n_searches int, text string")
    out = recovery.recovery_cascade(recovery.parsed_answers(answers), 0.7)
    got = {r["market_id"]: (r["chosen_tier"], r["accepted"], str(r["t_event"])) for r in out.collect()}
    assert got == {"a": (2, True, "2024-01-02 00:00:00"), "b": (1, False, "None")}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_market_fields_are_taken_in_one_pass(spark):
    """Objects and lists for texts, JSON nulls, events that are no list or hold no objects; one read of the VARIANT, one of each list."""
    rows = [(1, '{"id":"a","question":{"x":1},"events":{"title":"T"},"groupItemTitle":"G","slug":null}'),
            (2, '{"id":"b","question":[1],"events":["t"],"groupItemTitle":"H","volume":null}'),
            (3, '{"id":"c","question":null,"events":[null,{"title":"U"}],"conditionId":""}'), (4, '{"id":true,"events":[{"title":7}]}')]
    df = ingest.markets(spark.createDataFrame(rows, "ingest_no int, line string"))
    got = {r["market_id"]: (r["question"], r["category_raw"], r["slug"], r["volume"]) for r in df.collect()}
    assert got == {"a": ('{"x":1}', "G", None, None), "b": ("[1]", "H", None, None), "c": ("", "", None, None), "true": ("", "7", None, None)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") == 1 and plan.count("from_json") == 2

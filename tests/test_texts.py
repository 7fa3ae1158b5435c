"""Classification, parsing and recovery."""

from datetime import datetime

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.functions import text as T
from tidemark.plans import recovery as rec


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("question, expected", [
    ("Will Iran and Israel agree to a ceasefire?", "military_geopolitics"),
    ("Will OpenAI unveil a new device?", "corporate_disclosure"),
    ("Will the Supreme Court issue a ruling?", "regulatory_decision"),
    ("Will it snow in Denver?", "other"),
    ("How many seconds will the lap take?", "regulatory_decision"),  # the regulatory rule has no closing boundary
    ("Will the air strikes stop?", "other"),  # the military rule has one
])
def test_category(spark, question, expected):
    assert one(spark, question, lambda c: T.classify_category(c, F.lit(None).cast("string"), F.lit(""))) == expected


@pytest.mark.parametrize("question, expected", [
    ("Will X happen by March 31?", True), ("Will X happen before 2026?", True), ("Will X happen by Q2 2026?", True),
    ("Will X happen by the end of June 3rd, 2025?", True), ("Will X happen no later than 4/30?", True),
    ("Will X win the cup?", False), ("Will X stand by his words?", False)])
def test_deadline(spark, question, expected):
    df = spark.createDataFrame([(question, None)], "question string, description string")
    r = T.with_resolution_type(df).collect()[0]
    assert (r["resolution_type"] == "deadline_resolved") is expected and r["description_only"] is False


def test_deadline_in_description_only(spark):
    df = spark.createDataFrame([("Will X win?", "Resolves by December 31, 2025")], "question string, description string")
    assert T.with_resolution_type(df).collect()[0]["description_only"]


def test_regulatory_split_default_is_formal(spark):
    assert one(spark, "Will the FDA approval come at the PDUFA date?", T.classify_regulatory).endswith("announcement")
    assert one(spark, "Will the senator be indicted?", T.classify_regulatory).endswith("formal")
    assert one(spark, "Something else", T.classify_regulatory).endswith("formal")


def test_keywords_and_event_key(spark):
    assert one(spark, "Will the President of the United States visit the Old Town by May and May?", T.extract_keywords) == \
        ["president", "united", "states", "visit", "old"]
    assert one(spark, "Will the US launch 2 rockets?", T.event_key) == "launch 2 rockets"


@pytest.mark.parametrize("raw, expected", [
    ('["1","0"]', 1), ('["0","1"]', 0), ('["0.5","0.5"]', None), (None, None), ('["0.995","0.005"]', 1), ('["1"]', None), ("oops", None)])
def test_outcome(spark, raw, expected):
    assert one(spark, raw, P.outcome_from_prices) == expected


@pytest.mark.parametrize("raw, expected", [
    ("0xaa_0x" + "0" * 56 + "ffffffff", 0x7FFFFFFF), ("0xaa-17", 17), ("2147483650", 2), ("", 0), ("abc-x", 0),
    ("123456789012345678901234567890", 123456789012345678901234567890 % 2 ** 31), ("0xaa-2147483648", 2 ** 31), ("0xaa-5000000000", 5_000_000_000),
    ("0xaa-" + "9" * 25, int("9" * 25) % 2 ** 31)])
def test_log_index(spark, raw, expected):
    assert one(spark, raw, P.log_index) == expected


def test_log_index_of_other_suffix_is_stable(spark):
    import hashlib
    want = int(hashlib.md5(b"order7").hexdigest(), 16) % 2 ** 31
    assert one(spark, "tx_order7", P.log_index) == want


def test_hex_and_urls(spark):
    text = "q: see https://polymarket.com/e/1 and https://news.example.com/a, end"
    assert one(spark, "0x" + text.encode().hex(), P.decode_hex_text) == text
    assert one(spark, "not hex", P.decode_hex_text) == "not hex"
    assert one(spark, text, P.pick_evidence_url) == "https://news.example.com/a"
    assert one(spark, "only https://polymarket.com/e/1", P.pick_evidence_url) == "https://polymarket.com/e/1"


@pytest.mark.parametrize("raw, expected", [
    ("2025-03-01T10:00:00Z", datetime(2025, 3, 1, 10)), ("2025-03-01T10:00:00+02:00", datetime(2025, 3, 1, 8)),
    ("2025-03-01T10:00+0200", datetime(2025, 3, 1, 8)), ("2025-03-01T10:00", datetime(2025, 3, 1, 10)),
    ("2025-03-01**", datetime(2025, 3, 1)), ("March 1", None), ("2025-13-01", None)])
def test_dates(spark, raw, expected):
    assert one(spark, raw, P.parse_multi_format_ts) == expected


JSONLD = '<html><head><script type="application/ld+json">{"@type":"X","datePublished":"2025-02-01T09:30:00+01:00"}</script></head></html>'
OPENGRAPH = '<head><meta name="date" content="2020-01-01"><meta content="2025-02-03T00:00:00Z" property="article:published_time"/></head>'
TIMETAG = "<p><time>now</time><time class='x' datetime='2025-02-04'>then</time></p>"


@pytest.mark.parametrize("html, expected", [
    (JSONLD, datetime(2025, 2, 1, 8, 30)), (OPENGRAPH, datetime(2025, 2, 3)), (TIMETAG, datetime(2025, 2, 4)), ("<p>none</p>", None),
    (JSONLD.replace("2025-02-01T09:30:00+01:00", "soon") + TIMETAG, datetime(2025, 2, 4))])
def test_page_dates(spark, html, expected):
    assert one(spark, html, rec.publish_ts) == expected


def test_denied_pages_are_skipped(spark):
    df = spark.createDataFrame([("https://x.com/a", TIMETAG), ("ftp://a.example.com", TIMETAG), ("https://a.example.com", TIMETAG)], "url string, html string")
    assert [r["url"] for r in rec.from_pages(df).collect()] == ["https://a.example.com"]


def test_json_answers(spark):
    ok = 'Sure:\n```json\n{"T_event":"2025-01-02","confidence":0.8,"sources":["a","",null],"reasoning":"r"}\n```'
    df = spark.createDataFrame([(ok,), ("no json",), ('{"T_event": broken',), ('{"T_event":null,"confidence":0.1}',), ('{"T_event": }',)], "x string")
    a = rec.json_answer(F.col("x"))
    got = df.select(*[a[k].alias(k) for k in a]).collect()
    assert got[0]["t_event"] == datetime(2025, 1, 2) and got[0]["n_sources"] == 1 and got[0]["confidence"] == 0.8
    assert got[1]["reasoning"] == got[2]["reasoning"] == "No JSON in response"
    assert got[3]["t_event"] is None and got[4]["reasoning"] == "JSON parse error"


def test_cascade_sums_cost_until_accepted(spark):
    rows = [("a", 1, datetime(2025, 1, 1), 0.9, 1.0), ("a", 2, None, 0.0, 5.0), ("b", 1, None, 0.9, 1.0), ("b", 2, datetime(2025, 1, 2), 0.2, 2.0)]
    df = spark.createDataFrame(rows, "market_id string, tier int, t_event timestamp, confidence double, cost double").withColumn("model", F.lit("m"))
    got = {r["market_id"]: r for r in rec.recovery_cascade(df).collect()}
    assert got["a"]["cost"] == 1.0 and got["a"]["accepted"]
    assert got["b"]["cost"] == 3.0 and not got["b"]["accepted"] and got["b"]["t_event"] == datetime(2025, 1, 2)


def test_settle_log(spark):
    text = "market 0x12 ends"
    pad = lambda h: h.rjust(64, "0")
    body = pad("1") + pad("2") + pad("a0") + "f" * 64 + pad("0") + pad(f"{len(text):x}") + text.encode().hex().ljust(64, "0")
    df = spark.createDataFrame([("0x" + body, "0x" + "0" * 24 + "ab" * 20), ("0x00", "0x" + "0" * 24 + "cd" * 20)], "d string, t string")
    f = P.settle_log_fields(F.col("d"), F.col("t"))
    got = df.select(*[f[k].alias(k) for k in f]).collect()
    assert got[0]["ancillary_text"] == text and got[0]["price"] == "-1" and got[0]["proposer"] == "0x" + "ab" * 20
    assert got[1]["ancillary_text"] is None


@pytest.mark.parametrize("n", [0, 1, -1, 10 ** 18, 2 * 10 ** 18, 2 ** 60, 2 ** 64 + 5, -2 * 10 ** 18, 10 ** 40, -10 ** 60, 2 ** 255 - 1, -2 ** 255])
def test_signed_256_bit_words(spark, n):
    assert one(spark, f"{n % 2 ** 256:064x}", P.signed_hex_text) == str(n)


def test_ids_of_any_shape(spark):
    long = "0x" + "ab" * 32
    assert one(spark, f"res for {long} and id:4711, not x12 but 0x9f.", P.embedded_ids) == [long, "4711", "0x9f"]


def test_topic_keywords_are_plain_text(spark):
    topic = lambda q: one(spark, q, lambda c: T.classify_topic(F.lit("other"), F.lit(""), c))
    assert topic("Curry assists o/u 7.5") == "sports" and topic("Will a new $sol token launch? fdv") == "crypto"
    assert topic("Will Kanye tour?") == "entertainment" and topic("Chancellor of Germany") == "politics" and topic("Dow Jones above 40k") == "economics"


def test_articles_match_substrings(spark):
    m = spark.createDataFrame([("m", "Will troops enter Ukraine?", datetime(2025, 1, 1, 12), datetime(2025, 1, 9))],
                              "market_id string, question string, t_open timestamp, t_resolve timestamp")
    a = spark.createDataFrame([
        (datetime(2025, 1, 1, 11), "UKRAINE", "u0", "p"), (datetime(2025, 1, 3), "WORLD;EASTUKRAINEX_WAR", "u1", "p"),
        (datetime(2025, 1, 2), "SPORT", "u2", "p"), (datetime(2025, 1, 4), "TROOPS", "u3", "p")], "ts timestamp, themes string, url string, publisher string")
    r = rec.from_articles(m, a).collect()
    assert len(r) == 1 and r[0]["source_url"] == "u1"


def test_words_within_against_brute_force(spark):
    """Parts at the start, inside and at the end of words, whole words, repeated trigrams, parts that share all trigrams but not their order, and short ones."""
    rng = random.Random(8)
    words = {"".join(rng.choice("ABC") for _ in range(rng.randrange(1, 12))) for _ in range(400)} | {"CEASEFIRE", "FIREWORKS", "MISFIRED", "ABABAB", "BABA"}
    parts = {w[i:j] for w in sorted(words)[:80] for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {"FIRE", "CEASE", "WORKS", "ABCABD", "AB", "A", "", "BABAB", "XYZ"}
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in xs] * 2 + [(None,)], f"{name} string")
    got = {(r.kw, r.run) for r in rec.words_within(frame(parts, "kw"), frame(words, "run")).collect()}
    assert got == {(p, w) for p in parts for w in words if len(p) >= 3 and p in w}
    assert rec.words_within(frame(parts, "kw"), frame(words, "run").limit(0)).count() == 0


def test_settle_words_take_no_steps_of_their_own(spark):
    """Random words, upper case, NULL and words that are none; the plan of a log holds no loop over the pieces of a word."""
    rng = random.Random(9)
    numbers = [rng.randrange(-2 ** k, 2 ** k) for k in (1, 30, 62, 63, 64, 127, 128, 200, 254, 255) for _ in range(5)]
    words = [f"{n % 2 ** 256:064x}" for n in numbers] + ["F" * 63 + "e", None, "", "f" * 63, "g" * 64]
    df = spark.createDataFrame(list(enumerate(words)), "k int, w string")
    got = [r["t"] for r in df.select("k", P.signed_hex_text(F.col("w")).alias("t")).orderBy("k").collect()]
    assert got == [str(n) for n in numbers] + ["-2", None, None, None, None]
    f = P.settle_log_fields(F.col("w"), F.col("w"))
    plan = df.select(*[f[k].alias(k) for k in f])._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan

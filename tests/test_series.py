"""Series and time lookups against plain Python."""

import random
import re
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_scores import PRICES, T0, at, prices_df, trades_df
from tidemark.operators import hot
from tidemark.operators import series as ser
from tidemark.operators.asof import first_at_or_after, last_before, nearest_within
from tidemark.operators.hot import attach, join_hot


def test_forward_fill_and_vwap(spark):
    t = trades_df(spark, [(0, 0.3, 10), (5, 0.5, 10), (5, 0.7, 30)])
    rows = ser.fill_minutes(ser.vwap_buckets(t)).orderBy("ts").collect()
    assert [float(r["mid_price"]) for r in rows] == [0.3] * 5 + [0.65]
    assert [float(r["volume"]) for r in rows] == [3.0, 0, 0, 0, 0, 26.0]


def test_fill_crosses_days(spark):
    t = trades_df(spark, [(1438, 0.3, 10), (1443, 0.5, 10), (4000, 0.6, 10)])
    rows = ser.fill_minutes(ser.vwap_buckets(t)).orderBy("ts").collect()
    assert len(rows) == 4000 - 1438 + 1
    assert [r["ts"] for r in rows] == [at(m) for m in range(1438, 4001)]


def test_granularity(spark):
    t = trades_df(spark, [(1, 0.2, 10), (4, 0.4, 10), (6, 0.9, 10)])
    assert sorted(float(r["mid_price"]) for r in ser.vwap_buckets(t, "5min").collect()) == [0.3, 0.9]


def test_price_at_window_is_inclusive(spark):
    p = prices_df(spark, [(at(100), Decimal("0.4"))])
    t = trades_df(spark, [(195, 0.2, 10), (205, 0.6, 10)])
    t = t.unionByName(trades_df(spark, [(205, 0.9, 1000)]).withColumn("ts", F.expr("ts + interval 1 second")).withColumn("tx_hash", F.lit("z")))
    asked = spark.createDataFrame([("m", at(103)), ("m", at(200)), ("m", at(300))], "market_id string, t timestamp")
    got = {r["t"]: (r["price"] and float(r["price"]), r["source"]) for r in ser.price_at(asked, p, t).collect()}
    assert got == {at(103): (0.4, "quotes"), at(200): (0.4, "trade_vwap"), at(300): (None, "not_found")}


def test_baseline_inverts_trades(spark):
    t = trades_df(spark, [(0, 0.2, 10), (10, 0.4, 10), (5000, 0.9, 10)])
    c = spark.createDataFrame([("m", at(1000)), ("x", at(1000))], "market_id string, cutoff timestamp")
    got = {r["market_id"]: r for r in ser.baseline_price(c, spark.createDataFrame([], PRICES), t).collect()}
    assert float(got["m"]["baseline_price"]) == 0.7 and got["m"]["n_trades_before"] == 2
    assert got["x"]["baseline_source"] == "none"


def _random_case(spark, seed):
    rnd = random.Random(seed)
    facts = {(k, T0 + timedelta(minutes=rnd.randrange(0, 6000))) for k in "ab" for _ in range(80)}
    facts = [(k, ts, float(i)) for i, (k, ts) in enumerate(sorted(facts))]
    asks = [(k, T0 + timedelta(minutes=rnd.randrange(-500, 6600))) for k in "abc" for _ in range(60)]
    asks = sorted(set(asks))
    return (facts, asks, spark.createDataFrame(facts, "key string, ts timestamp, v double"),
            spark.createDataFrame(asks, "key string, t timestamp"))


def test_lookups_match_brute_force(spark):
    facts, asks, fdf, adf = _random_case(spark, 7)
    near = {(r["key"], r["t"]): r["v"] for r in nearest_within(adf, fdf, "key", "t", "ts", "v", 5).collect()}
    back = {(r["key"], r["t"]): r["v"] for r in last_before(adf, fdf, "key", "t", "ts", "v").collect()}
    hi = adf.withColumn("hi", F.expr("t + interval 30 hours"))
    ahead = {(r["key"], r["t"]): r["v"] for r in first_at_or_after(hi, fdf, "key", "t", "hi", "ts", "v").collect()}
    for k, t in asks:
        mine = [(ts, v) for kk, ts, v in facts if kk == k]
        close = [(abs(ts - t), ts, v) for ts, v in mine if abs(ts - t) <= timedelta(minutes=5)]
        assert near[k, t] == (min(close)[2] if close else None)
        older = [(ts, v) for ts, v in mine if ts < t]
        assert back[k, t] == (max(older)[1] if older else None)
        later = [(ts, v) for ts, v in mine if t <= ts <= t + timedelta(hours=30)]
        assert ahead[k, t] == (min(later)[1] if later else None)


def test_sparse_lookup_equals_dense_series(spark):
    rnd = random.Random(3)
    minutes = sorted({rnd.randrange(100, 4000) for _ in range(60)})
    t = trades_df(spark, [(m, rnd.randrange(1, 100) / 100, 10) for m in minutes])
    points, bounds = ser.prepare_series(spark.createDataFrame([], PRICES), t)
    dense = {r["ts"]: float(r["mid_price"]) for r in ser.fill_minutes(ser.vwap_buckets(t)).collect()}
    asks = [(at(m), f) for m in range(80, 4020, 7) for f in (True, False)]
    adf = spark.createDataFrame([("m", f"{i}", a, f) for i, (a, f) in enumerate(asks)],
                                "market_id string, kind string, t timestamp, forward boolean")
    got = {r["kind"]: r["mid_price"] for r in ser.lookup_prices(adf, points, bounds).collect()}
    for i, (a, forward) in enumerate(asks):
        if forward:
            hits = [(ts, p) for ts, p in dense.items() if a <= ts <= a + timedelta(hours=24)]
        else:
            hits = [(abs(ts - a), ts, p) for ts, p in dense.items() if abs(ts - a) <= timedelta(minutes=5)]
        want = min(hits)[-1] if hits else None
        assert (got[str(i)] is None and want is None) or abs(float(got[str(i)]) - want) < 1e-9


@pytest.mark.parametrize("rows", [2_000_000, 100])
def test_join_hot_keeps_every_row_and_repeats_heavy_keys_only(spark, rows):
    spark.conf.set(hot.ROWS_CONF, str(rows))
    try:
        fact = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"), "id")
        dim = fact.select("k").distinct().withColumn("d", F.length("k"))
        heavy = hot.heavy_keys(fact, ["k"])
        assert sorted(heavy.values()) == ([] if rows > 100 else [17])  # 1667 of one key; 67 NULLs are not heavy
        j = join_hot(fact, dim, ["k"], spread=["id"])
        assert ("_salt" in j._jdf.queryExecution().optimizedPlan().toString()) is bool(heavy)
        known = fact.where("k is not null").count()
        assert j.count() == known and j.select("id").distinct().count() == known
        salted = dim.withColumn("n", hot._salts(heavy, ["k"]))
        assert salted.where("n > 1").count() == len(heavy) and salted.agg(F.sum("n")).first()[0] == dim.count() + 16 * len(heavy)
        only = dim.where("k = 'hot'")
        assert join_hot(fact, only, ["k"], "left", ["id"]).where("d is null").count() == fact.where("k is null or k <> 'hot'").count()
        assert join_hot(fact, only, ["k"], "left_semi", ["id"]).count() == 1667
        nulls = fact.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
        cells = nulls.groupBy("k").agg(F.count("*").alias("n"))
        got = attach(nulls, cells, ["k"])
        assert got.count() == 5000 and got.where("k is null").select("n").distinct().collect()[0][0] == 5000 - known + 1667
    finally:
        spark.conf.unset(hot.ROWS_CONF)


@pytest.mark.parametrize("key", ["ils_standard", "market_labels"])
def test_lookups_meet_stored_bars_without_an_exchange(spark, key):
    """Without broadcasts the scan of the bars stands bucketed under a sort-merge join, with nothing but a sort and a filter between."""
    from tidemark.catalog import load_all
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load_all()[key].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [k for k, line in enumerate(plan) if "tidemark_bars" in line and "FileScan" in line]
    assert scans
    for k in scans:
        assert "Bucketed: true" in plan[k]
        depth = lambda line: len(re.match(r"[\s:|+\-*()\d]*", line).group())
        at, above = depth(plan[k]), []
        for line in reversed(plan[:k]):
            if depth(line) < at:
                at = depth(line)
                above.append(line.strip(" :+-*()0123456789"))
                if "Join" in line:
                    break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above), above
    assert sum("FileScan" in line and "notional_usdc" in line for line in plan) <= 1  # the trades are read once at most

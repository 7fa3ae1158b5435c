"""Wallet features, ranked reports, ledgers."""

from datetime import timedelta
from decimal import Decimal

import pytest

from tests.test_scores import T0, TRADES, at
from tidemark.operators import audits as au
from tidemark.operators import features as feat


def _trades(spark, notionals, side="BUY", outcome=1):
    return spark.createDataFrame([
        ("m", at(i), f"t{i}", 0, f"w{i:02d}", "mk", side, outcome, Decimal("0.5"), Decimal(2 * n), Decimal(n))
        for i, n in enumerate(notionals)], TRADES)


def _refs(spark, p=1):
    return spark.createDataFrame([("m", at(1000), p)], "market_id string, t_news timestamp, p_resolve int")


@pytest.mark.parametrize("notionals, hhi", [([10], 1.0), ([5, 5, 5, 5], 0.25), ([10, 30], 0.625)])
def test_concentration(spark, notionals, hhi):
    r = feat.wallet_features(_trades(spark, notionals), _refs(spark)).collect()[0]
    assert float(r["wallet_hhi_top10"]) == hhi


def test_top_ten_only_and_ordered(spark):
    r = feat.wallet_features(_trades(spark, list(range(1, 16))), _refs(spark)).collect()[0]
    got = [x["notional_usdc"] for x in r["time_to_news_top10"]]
    assert got == [float(n) for n in range(15, 5, -1)]
    assert r["time_to_news_top10"][0]["minutes_before_news"] == 986.0


def test_wrong_side_gives_nothing(spark):
    assert feat.wallet_features(_trades(spark, [10], side="SELL"), _refs(spark)).count() == 0
    assert feat.wallet_features(_trades(spark, [10], side="SELL", outcome=0), _refs(spark, 0)).count() == 1


def test_funding_merges_case_and_cuts_at_ten(spark):
    rows = [("W1", f"0xA{i}", 1_000_000 * (i + 1)) for i in range(15)] + [("w1", "0xa14", 500_000), ("other", "w1", 9_000_000)]
    df = spark.createDataFrame(rows, "to_address string, from_address string, value_units bigint")
    got = feat.funding_sources(df).where("address = 'w1'").orderBy("rank").collect()
    assert len(got) == 10 and got[0]["counterparty"] == "0xa14" and float(got[0]["total_usdc"]) == 15.5 and got[0]["n_transfers"] == 2


def test_volume_without_trades_is_null(spark):
    refs = spark.createDataFrame([("none", T0, T0 + timedelta(days=1))], "market_id string, t_news timestamp, t_resolve timestamp")
    r = feat.volume_features(_trades(spark, [10]), refs).collect()[0]
    assert r["n_trades_total"] == 0 and r["volume_pre_share"] is None and r["pre_news_max_jump"] is None


def test_top_n_is_cut_before_the_shuffle(spark):
    from pyspark.sql import functions as F
    plan = feat.top_n(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_calibration_flags_bad_bins(spark):
    df = spark.createDataFrame([(0.95, 0)] * 6 + [(0.05, 0)] * 6, "p double, o int")
    got = {r["bin"]: r for r in au.calibration(df, "p", "o").collect()}
    assert got[9]["miscalibrated"] and not got[0]["miscalibrated"]
    assert abs(got[0]["brier"] - (6 * 0.95 ** 2 + 6 * 0.05 ** 2) / 12) < 1e-12


def test_histogram_fills_and_clips(spark):
    df = spark.createDataFrame([("a", -9.0), ("a", 0.05), ("a", 7.0)], "g string, x double")
    got = {r["bin"]: r["n"] for r in au.even_histogram(df, ["g"], "x", -0.5, 1.5, 10).collect()}
    assert got[0] == 1 and got[9] == 1 and got[2] == 1 and sum(got.values()) == 3 and len(got) == 10


def test_attrition_counts_every_row(spark):
    df = spark.createDataFrame([("",)] * 3 + [("a",)] * 2 + [("b: x",)] * 4, "exclusion_reason string")
    got = [(r["stage"], r["n"], r["dropped"]) for r in au.filter_attrition(df, ["a", "b", "c"]).orderBy("step").collect()]
    assert got == [("initial", 9, 0), ("after_a", 7, 2), ("after_b", 3, 4), ("after_c", 3, 0)]


def test_hot_joins_take_only_kinds_that_salting_leaves_right(spark):
    import pytest

    from tidemark.operators.hot import ROWS_CONF, attach, join_hot
    fact = spark.createDataFrame([(1, 10), (1, 11), (1, 14), (2, 12), (None, 13)], "k int, v int")
    dim = spark.createDataFrame([(1, "a"), (3, "c")], "k int, d string")
    got = {}
    for rows in ("2000000", "1"):
        spark.conf.set(ROWS_CONF, rows)
        try:
            for how in ("inner", "left", "left_semi", "left_anti"):
                got.setdefault(how, []).append(sorted(map(str, join_hot(fact, dim, ["k"], how).collect())))
        finally:
            spark.conf.unset(ROWS_CONF)
    assert all(a == b for a, b in got.values())
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            join_hot(fact, dim, ["k"], how)
        with pytest.raises(ValueError):
            attach(fact, dim, ["k"], how)

"""Score regimes on small hand-made series."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.series import prepare_series, series_bounds
from tidemark.plans import scoring as plan

T0 = datetime(2025, 1, 1)
PRICES = "market_id string, ts timestamp, mid_price decimal(8,6)"
TRADES = ("market_id string, ts timestamp, tx_hash string, log_index int, taker_address string, maker_address string, side string, "
          "outcome_index int, price decimal(8,6), size_shares decimal(20,6), notional_usdc decimal(20,6)")


def at(minute):
    return T0 + timedelta(minutes=minute)


def linear(points, last=720):
    """Minute series through (minute, price) corners."""
    out = []
    for m in range(last + 1):
        before = max((p for p in points if p[0] <= m), key=lambda p: p[0])
        after = min((p for p in points if p[0] >= m), key=lambda p: p[0], default=before)
        w = 0 if after[0] == before[0] else (m - before[0]) / (after[0] - before[0])
        out.append((at(m), Decimal(f"{before[1] + (after[1] - before[1]) * w:.6f}")))
    return out


def prices_df(spark, series, market="m"):
    return spark.createDataFrame([(market, ts, p) for ts, p in series], PRICES)


def no_trades(spark):
    return spark.createDataFrame([], TRADES)


def trades_df(spark, rows):
    """rows: (minute, price, shares)"""
    return spark.createDataFrame([
        ("m", at(m), f"tx{i}", 0, f"w{i}", "mk", "BUY", 1, Decimal(str(p)), Decimal(q), Decimal(str(p)) * Decimal(q))
        for i, (m, p, q) in enumerate(rows)], TRADES)


def market(spark, t_open, t_resolve, outcome=1, rtype="event_resolved"):
    return spark.createDataFrame([("m", t_open, t_resolve, outcome, rtype, "other")],
                                 "market_id string, t_open timestamp, t_resolve timestamp, outcome int, resolution_type string, category string")


def news(spark, t, tier=1, conf="0.90"):
    return spark.createDataFrame([("m", t, tier, Decimal(conf))], "market_id string, t_news timestamp, tier int, confidence decimal(3,2)")


def standard(spark, series, news_minute=480, outcome=1):
    s, b = prepare_series(prices_df(spark, series), no_trades(spark))
    refs = plan.standard_refs(market(spark, T0, at(720), outcome), news(spark, at(news_minute)))
    return plan.score(refs, s, b).collect()[0]


@pytest.mark.parametrize("corners, low, high", [
    ([(0, 0.15), (480, 0.99), (720, 0.99)], 0.95, 1.05),
    ([(0, 0.15), (480, 0.15), (481, 0.99), (720, 0.99)], -0.05, 0.05),
    ([(0, 0.15), (480, 0.55), (481, 0.99), (720, 0.99)], 0.45, 0.55),
    ([(0, 0.30), (480, 0.20), (481, 0.99), (720, 0.99)], -1.0, -0.0001),
])
def test_standard_regimes(spark, corners, low, high):
    r = standard(spark, linear(corners))
    assert low <= float(r["ils"]) <= high
    assert r["status"] == "ok"


def test_low_information(spark):
    r = standard(spark, linear([(0, 0.98), (480, 0.98), (481, 0.99), (720, 0.99)]))
    assert r["ils"] is None and "low_information_market" in r["flags"]


def test_windows_follow_the_ramp(spark):
    r = standard(spark, linear([(0, 0.15), (450, 0.15), (480, 0.90), (720, 0.99)]))
    assert abs(float(r["ils_30min"]) - float(r["ils"])) < 0.01
    assert r["ils_24h"] is None and "window_24h_predates_topen" in r["flags"]
    assert r["flags"].index("window_24h_predates_topen") < r["flags"].index("window_7d_predates_topen")


def deadline(spark, points, t_resolve, outcome=1, t_event=None):
    s, b = prepare_series(prices_df(spark, [(at(m), Decimal(str(p))) for m, p in points]), no_trades(spark))
    ev = spark.createDataFrame([("m", t_event)] if t_event else [], "market_id string, t_event timestamp")
    return plan.score(plan.deadline_refs(market(spark, T0, t_resolve, outcome), ev), s, b).collect()[0]


@pytest.mark.parametrize("p_open, p_ref, low, high", [
    (0.1, 0.98, 0.90, 1.1), (0.3, 0.3, -0.01, 0.01), (0.2, 0.6, 0.49, 0.51), (0.5, 0.3, -0.41, -0.39)])
def test_deadline_regimes(spark, p_open, p_ref, low, high):
    r = deadline(spark, [(0, p_open), (5699, p_ref), (5700, p_ref), (5701, p_ref)], at(5760))
    assert low <= float(r["ils"]) <= high


def test_deadline_overshoot(spark):
    r = deadline(spark, [(0, 0.10), (5700, 0.90)], at(5760), outcome=0)
    assert float(r["ils"]) == -8.0


def test_deadline_event_flag_and_short_market(spark):
    r = deadline(spark, [(0, 0.2), (100, 0.7)], at(5760), t_event=at(101))
    assert r["flags"][0] == "t_event_recovered" and float(r["p_ref"]) == 0.7
    r = deadline(spark, [(0, 0.2), (29, 0.9)], at(30))
    assert "lookback_predates_topen" in r["flags"] and r["t_ref"] == T0


def test_price_gap_gives_a_row_with_status(spark):
    r = deadline(spark, [(0, 0.2), (10, 0.3)], at(5760))
    assert r["status"] == "price_gap_tref" and r["ils"] is None


def test_late_first_quote_is_found_forward(spark):
    r = standard(spark, [(at(20), Decimal("0.45")), (at(480), Decimal("0.60"))])
    assert float(r["p_open"]) == 0.45 and r["status"] == "ok"


def test_sources_and_snap(spark):
    one_quote = prices_df(spark, [(at(0), Decimal("0.5"))])
    t = trades_df(spark, [(30, 0.2, 10), (40, 0.4, 10)])
    s, b = prepare_series(one_quote, t)
    row = b.collect()[0]
    assert row["source"] == "trade_vwap" and row["n_points"] == 2
    snapped = plan.snap_open(market(spark, T0, at(720)), b).collect()[0]
    assert snapped["t_open"] == at(30) and snapped["t_open_snapped"]
    assert series_bounds(s, "quotes").count() == 0


def test_market_labels_end_to_end(spark):
    t = trades_df(spark, [(0, 0.2, 100), (100, 0.4, 50), (479, 0.6, 50), (600, 0.9, 100)])
    r = plan.market_labels(market(spark, T0, at(720)), prices_df(spark, []), t, news(spark, at(480))).collect()[0]
    assert r["price_source"] == "trade_vwap" and float(r["ils"]) == 0.5
    assert (r["n_trades_total"], r["n_trades_pre_news"]) == (4, 3)
    assert float(r["volume_pre_share"]) == round((20 + 20 + 30) / (20 + 20 + 30 + 90), 6)
    assert [x["address"] for x in r["time_to_news_top10"]] == ["w2", "w0", "w1"]
    audit = plan.label_audit(plan.market_labels(market(spark, T0, at(720)), prices_df(spark, []), t, news(spark, at(480))))
    assert audit.select(F.get_json_object("details", "$.t_news_tier")).collect()[0][0] == "1"


def test_candidates_join_markets_once(spark):
    """Pools by prices and news; NULL and repeated ids; one join of the markets with labels, not one per pool."""
    ids = ["a", "b", "c", "d", "e", None, "a"]
    kinds = ["deadline_resolved", "deadline_resolved", "event_resolved", "event_resolved", None, "deadline_resolved", "event_resolved"]
    m = spark.createDataFrame([(i, k, T0, at(9), 1) for i, k in zip(ids, kinds)], "market_id string, resolution_type string, t_open timestamp, t_resolve timestamp, outcome int")
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "market_id string")
    df = plan.score_candidates(m, one(["a", "c", None, "a"]), one(["a", "b", "d", "e", None]), one(["d", None]))
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("b", 2), ("e", 2)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1

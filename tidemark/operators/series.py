"""Price series from trades and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import LOOKUP_TOLERANCE_MIN, TOPEN_FORWARD_HOURS
from tidemark.functions.numeric import PRICE, clamp01, ratio
from tidemark.operators import history
from tidemark.operators.asof import last_before, nearest_within, neighbours
from tidemark.operators.history import History
from tidemark.session import staged

GRANULARITY = {"1min": 60, "5min": 300, "1h": 3600}


def time_floor(c: Column, granularity: str = "1min") -> Column:
    """Start of the minute, five minutes or hour that holds ``c``."""
    if granularity == "1min":
        return F.date_trunc("minute", c)
    width = GRANULARITY[granularity]
    return F.timestamp_seconds(F.floor(F.unix_seconds(c) / width) * width)


def vwap_buckets(trades: DataFrame, granularity: str = "1min") -> DataFrame:
    """Per (market, bucket): notional / shares clamped to [0, 1]; NULL where no shares traded."""
    return (trades.groupBy("market_id", time_floor(F.col("ts"), granularity).alias("ts"))
            .agg(F.sum("notional_usdc").alias("volume"), F.sum("size_shares").alias("shares"))
            .select("market_id", "ts",
                    F.when(F.col("shares") > 0, clamp01(ratio(F.col("volume"), F.col("shares")))).cast(PRICE)
                    .alias("mid_price"), F.col("volume")))


def weighted_price_buckets(trades: DataFrame, yes_outcome_index: int = 1) -> DataFrame:
    """Per (market, minute) over YES trades: price weighted by notional."""
    return (trades.where(F.col("outcome_index") == yes_outcome_index)
            .groupBy("market_id", F.date_trunc("minute", "ts").alias("ts"))
            .agg(F.sum((F.col("price") * F.col("notional_usdc")).cast("decimal(38,12)")).alias("pn"),
                 F.sum("notional_usdc").alias("n"))
            .select("market_id", "ts", ratio(F.col("pn"), F.col("n")).cast(PRICE).alias("mid_price"))
            .where(F.col("mid_price").isNotNull()))


def fill_minutes(buckets: DataFrame) -> DataFrame:
    """Dense minutes from first to last bucket of a market; price carried forward, volume 0 between.

    Each bucket produces the minutes up to the next bucket. The next bucket is found inside a
    (market, day), and for the last bucket of a day from a window over days, so no window holds
    more than a day of minutes or the days of one market.
    """
    b = buckets.where(F.col("mid_price").isNotNull()).withColumn("_d", F.to_date("ts"))
    first = b.groupBy("market_id", "_d").agg(F.min("ts").alias("_f"))
    nxt_day = first.withColumn("_nd", F.lead("_f").over(Window.partitionBy("market_id").orderBy("_d"))).drop("_f")
    in_day = b.withColumn("_n", F.lead("ts").over(Window.partitionBy("market_id", "_d").orderBy("ts")))
    end = F.coalesce("_n", "_nd", F.col("ts") + F.expr("interval 1 minute"))
    return (in_day.join(nxt_day, ["market_id", "_d"])
            .withColumn("_m", F.explode(F.sequence(F.col("ts"), end - F.expr("interval 1 minute"),
                                                   F.expr("interval 1 minute"))))
            .select("market_id", F.col("_m").alias("ts"), "mid_price",
                    F.when(F.col("_m") == F.col("ts"), F.col("volume")).otherwise(F.lit(0)).alias("volume")))


def fill_missing(prices: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Quotes plus synthetic minutes where the market has no quote for that minute."""
    extra = synthetic.join(prices.select("market_id", "ts"), ["market_id", "ts"], "left_anti")
    return (prices.select("market_id", "ts", "mid_price").withColumn("origin", F.lit("quote"))
            .unionByName(extra.select("market_id", "ts", "mid_price").withColumn("origin", F.lit("trades"))))


def all_points(prices: DataFrame, trades: DataFrame, granularity: str = "1min") -> DataFrame:
    """Quotes and traded buckets side by side, one row per (market, source, bucket)."""
    return (prices.select("market_id", F.lit("quotes").alias("source"), "ts", F.col("mid_price").cast(PRICE)
                          .alias("mid_price"))
            .unionByName(vwap_buckets(trades, granularity).where("mid_price is not null")
                         .select("market_id", F.lit("trade_vwap").alias("source"), "ts", "mid_price")))


def series_bounds(points: DataFrame | History, price_source: str = "auto") -> DataFrame:
    """Chosen source of each market with the first and last point of its series.

    ``auto`` takes quotes when there are at least two, otherwise trades; the other modes take one
    source or nothing.
    """
    if isinstance(points, History):
        return history_bounds(points, price_source)
    return _bounds(points.groupBy("market_id", "source").agg(
        F.count("*").alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("mid_price", "ts").alias("first_price")), price_source)


def _bounds(per: DataFrame, price_source: str) -> DataFrame:
    ok = F.when(F.col("source") == "quotes", F.col("n_points") >= 2).otherwise(True)
    if price_source != "auto":
        return per.where(ok & (F.col("source") == price_source))
    best = per.where(ok).groupBy("market_id").agg(F.min(F.struct(
        "source", "n_points", "first_ts", "last_ts", "first_price")).alias("b"))
    return best.select("market_id", "b.*")


def store_history(prices: DataFrame, trades: DataFrame) -> History:
    """All minute bars of quotes and trades, written once for any number of jobs."""
    return history.store(all_points(prices, trades), prices.count() + trades.count())


def _day_bounds(bars: History) -> DataFrame:
    per = bars.days.groupBy("market_id", "source").agg(F.sum("n").alias("n_points"), F.min("_first").alias("_f"), F.max("_last._ts").alias("last_ts"))
    return per.select("market_id", "source", "n_points", F.col("_f._ts").alias("first_ts"), "last_ts", F.col("_f._v").alias("first_price"))


def history_bounds(bars: History, price_source: str = "auto") -> DataFrame:
    """``series_bounds`` of a stored history, from its days."""
    return staged(_bounds(_day_bounds(bars), price_source))


def quote_bounds(bars: History) -> DataFrame:
    """Bounds of the quotes alone, of every market that has any."""
    return staged(_day_bounds(bars).where("source = 'quotes'"))


def prepare_series(prices: DataFrame, trades: DataFrame, price_source: str = "auto") -> tuple[History, DataFrame]:
    """Stored bars and their bounds, for jobs that look prices up more than once."""
    bars = store_history(prices, trades)
    return bars, history_bounds(bars, price_source)


def market_sources(prices: DataFrame, trades: DataFrame, price_source: str = "auto") -> DataFrame:
    """(market_id, source) as chosen by ``series_bounds``."""
    return series_bounds(all_points(prices, trades), price_source).select("market_id", "source")


def lookup_prices(lookups: DataFrame, points: DataFrame | History, bounds: DataFrame) -> DataFrame:
    """Price per lookup (market_id, kind, t, forward), as on the filled minute series, without filling.

    ``forward`` asks for the first price in 24 hours from ``t``; otherwise the nearest within five
    minutes, the earlier one on a tie. A traded series is a step function between its first and last
    bucket, so there the answer is the last bucket at or before ``t``, or the edge bucket when ``t``
    lies just outside.
    """
    asked = (lookups.join(bounds.select("market_id", "source", "last_ts"), "market_id")
             .select("market_id", "kind", "t", "forward", "source", "last_ts",
                     F.date_trunc("minute", "t").alias("m")))
    if isinstance(points, History):
        n = history.neighbours(asked, points, "m")
    else:
        keyed = points.select(F.struct("market_id", "source").alias("_ms"), "ts", "mid_price")
        n = neighbours(asked.withColumn("_ms", F.struct("market_id", "source")), keyed, "_ms", "m", "ts", "mid_price")
    back = F.unix_seconds("m") - F.unix_seconds("prev._ts")
    ahead = F.unix_seconds("next._ts") - F.unix_seconds("m")
    tol, wide = LOOKUP_TOLERANCE_MIN * 60, TOPEN_FORWARD_HOURS * 3600
    first_ahead = F.when(ahead <= wide, F.col("next._v"))
    nearest = (F.when((back <= tol) & (ahead.isNull() | (back <= ahead)), F.col("prev._v"))
               .when(ahead <= tol, F.col("next._v")))
    inside = F.col("m") <= F.col("last_ts")
    step = (F.when(F.col("prev").isNotNull() & inside, F.col("prev._v"))
            .when(F.col("forward"), first_ahead).otherwise(nearest))
    price = F.when(F.col("source") == "trade_vwap", step).when(F.col("forward"), first_ahead).otherwise(nearest)
    return n.select("market_id", "kind", "t", price.alias("mid_price"))


def price_at(lookups: DataFrame, prices: DataFrame, trades: DataFrame, tolerance_min: int = 5) -> DataFrame:
    """(price, source) per lookup (market_id, t): nearest quote, else VWAP of the window, else not found."""
    near = nearest_within(lookups.select("market_id", "t"), prices, "market_id", "t", "ts", "mid_price",
                          tolerance_min)
    width, tol = tolerance_min * 120, tolerance_min * 60
    m = F.unix_seconds(F.date_trunc("minute", F.col("t")))
    asked = (lookups.select("market_id", "t").withColumn("_s", m)
             .withColumn("_b", F.explode(F.array_distinct(F.array(
                 F.floor((m - tol) / width), F.floor((m + tol) / width))))))
    # the window ends inclusively on a full minute, so trades are summed per minute, apart from
    # those on the exact start of a minute: two rows per (market, minute) at most
    minute = F.date_trunc("minute", "ts")
    fine = (trades.groupBy("market_id", minute.alias("_min"), (F.col("ts") == minute).alias("_exact"))
            .agg(F.sum("notional_usdc").alias("_n"), F.sum("size_shares").alias("_q"))
            .withColumn("_sec", F.unix_seconds("_min")).withColumn("_b", F.floor(F.col("_sec") / width)))
    off = F.col("_sec") - F.col("_s")
    vwap = (asked.join(fine, ["market_id", "_b"])
            .where((off >= -tol) & ((off < tol) | ((off == tol) & F.col("_exact"))))
            .groupBy("market_id", "t")
            .agg(clamp01(ratio(F.sum("_n"), F.sum("_q"))).cast(PRICE).alias("_vwap")))
    return (near.join(vwap, ["market_id", "t"], "left")
            .select("market_id", "t", F.coalesce(F.col("mid_price").cast(PRICE), "_vwap").alias("price"),
                    F.when(F.col("mid_price").isNotNull(), "quotes")
                    .when(F.col("_vwap").isNotNull(), "trade_vwap").otherwise("not_found").alias("source")))


def cutoff_vwap(trades: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per market: size-weighted price and number of trades strictly before the cutoff."""
    from tidemark.operators.hot import join_hot
    j = join_hot(trades.select("market_id", "ts", "tx_hash", "size_shares", "price"), cutoffs, ["market_id"],
                 spread=["tx_hash"]).where(F.col("ts") < F.col("cutoff"))
    return (j.groupBy("market_id", "cutoff")
            .agg(F.sum((F.col("size_shares") * F.col("price")).cast("decimal(38,12)")).alias("_sp"),
                 F.sum("size_shares").alias("_s"), F.count("*").alias("n_trades_before"))
            .select("market_id", "cutoff", ratio(F.col("_sp"), F.col("_s")).cast(PRICE).alias("vwap"),
                    "n_trades_before"))


def baseline_price(cutoffs: DataFrame, prices: DataFrame, trades: DataFrame) -> DataFrame:
    """Last quote before the cutoff, else 1 minus the VWAP of earlier trades, else none."""
    c = cutoffs.select("market_id", "cutoff")
    quote = last_before(c, prices, "market_id", "cutoff", "ts", "mid_price")
    return (quote.join(cutoff_vwap(trades, c), ["market_id", "cutoff"], "left")
            .select("market_id", "cutoff",
                    F.coalesce(F.col("mid_price").cast(PRICE), (F.lit(1) - F.col("vwap")).cast(PRICE))
                    .alias("baseline_price"),
                    F.when(F.col("mid_price").isNotNull(), "quote_mid")
                    .when(F.col("vwap").isNotNull(), "trade_vwap").otherwise("none").alias("baseline_source"),
                    F.when(F.col("mid_price").isNotNull(), F.lit(-1))
                    .otherwise(F.coalesce("n_trades_before", F.lit(0))).cast("long").alias("n_trades_before")))

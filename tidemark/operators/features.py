"""Volume and wallet features before a reference time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import minutes_between
from tidemark.operators.hot import join_hot
from tidemark.session import staged

MONEY = "decimal(24,6)"


def best_news(news: DataFrame) -> DataFrame:
    """Best candidate per market: lowest tier, then highest confidence, then earliest."""
    w = Window.partitionBy("market_id").orderBy("tier", F.desc("confidence"), "t_news")
    return news.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trades_in_window(trades: DataFrame, windows: DataFrame, lo: str | None, hi: str,
                     hi_inclusive: bool = True) -> DataFrame:
    """Trades joined to per-market time bounds."""
    j = join_hot(trades, windows, ["market_id"], spread=["tx_hash", "log_index"])
    cond = F.col("ts") <= F.col(hi) if hi_inclusive else F.col("ts") < F.col(hi)
    if lo:
        cond = cond & (F.col("ts") >= F.col(lo))
    return j.where(cond)


def volume_features(trades: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts, volume share and largest trade before ``t_news`` for refs (market_id, t_news, t_resolve).

    Both sides of the share come from one pass over the trades.
    """
    j = join_hot(trades.select("market_id", "ts", "notional_usdc", "tx_hash"),
                 refs.select("market_id", "t_news", "t_resolve"), ["market_id"], spread=["tx_hash"])
    return _volumes(j.groupBy("market_id").agg(*_volume_sums()), refs)


def _volume_sums() -> list[Column]:
    pre, total, n = F.col("ts") < F.col("t_news"), F.col("ts") <= F.col("t_resolve"), F.col("notional_usdc")
    return [F.count_if(total).alias("n_trades_total"), F.count_if(pre).alias("n_trades_pre_news"),
            F.sum(F.when(total, n)).alias("_total"), F.sum(F.when(pre, n)).alias("_pre"), F.max(F.when(pre, n)).alias("pre_news_max_jump")]


def _volumes(sums: DataFrame, refs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    share = F.bround(F.try_divide(F.coalesce(F.col("_pre"), zero).cast(MONEY), F.col("_total").cast(MONEY)), 6)
    out = refs.select("market_id").join(sums, "market_id", "left")
    return out.select(
        "market_id", F.coalesce("n_trades_total", F.lit(0)).alias("n_trades_total"),
        F.coalesce("n_trades_pre_news", F.lit(0)).alias("n_trades_pre_news"),
        F.when(F.col("_total") > 0, share).cast("decimal(18,6)").alias("volume_pre_share"), "pre_news_max_jump")


def label_features(trades: DataFrame, refs: DataFrame) -> DataFrame:
    """``volume_features`` and ``wallet_features`` together for refs (market_id, t_news, t_resolve, p_resolve), from one pass over the trades.

    The pass leaves one row per (market, taker), written, with what both sides add up.
    """
    j = join_hot(trades.select("market_id", "ts", "taker_address", "side", "outcome_index", "price", "notional_usdc", "tx_hash"),
                 refs.select("market_id", "t_news", "t_resolve", "p_resolve"), ["market_id"], spread=["tx_hash"])
    ours = _aligned()
    per = staged(j.groupBy("market_id", "t_news", F.col("taker_address").alias("address")).agg(
        *_volume_sums(), F.sum(F.when(ours, F.col("notional_usdc"))).alias("notional"), F.min(F.when(ours, F.col("ts"))).alias("first_trade_ts"),
        F.count_if(ours).alias("n_trades")))
    sums = per.groupBy("market_id").agg(*[F.sum(c).alias(c) for c in ("n_trades_total", "n_trades_pre_news", "_total", "_pre")], F.max("pre_news_max_jump").alias("pre_news_max_jump"))
    return _volumes(sums, refs).join(_top_wallets(per.where("n_trades > 0")), "market_id", "left")


def _aligned() -> Column:
    """Is a trade before the news, on the side and outcome that the market resolved to?"""
    side = F.when(F.col("p_resolve") == 1, "BUY").otherwise("SELL")
    return F.coalesce((F.col("ts") < F.col("t_news")) & (F.col("side") == side) & (F.col("outcome_index") == F.col("p_resolve")), F.lit(False))


def aligned_wallets(trades: DataFrame, refs: DataFrame) -> DataFrame:
    """Per (market, taker): trades on the winning side before ``t_news``.

    Aligned means a BUY of outcome 1 when the market resolved to 1, a SELL of outcome 0 otherwise.
    """
    j = join_hot(trades.select("market_id", "ts", "taker_address", "side", "outcome_index", "price",
                               "notional_usdc", "tx_hash"),
                 refs.select("market_id", "t_news", "p_resolve"), ["market_id"], spread=["tx_hash"])
    return (j.where(_aligned())
            .groupBy("market_id", "t_news", F.col("taker_address").alias("address"))
            .agg(F.sum("notional_usdc").alias("notional"), F.min("ts").alias("first_trade_ts"),
                 F.count("*").alias("n_trades"), F.avg(F.lit(1) - F.col("price").cast("double")).alias("avg_inverted")))


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key; the limit is applied before the shuffle as well as after it."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def wallet_features(trades: DataFrame, refs: DataFrame) -> DataFrame:
    """Concentration of the ten largest aligned wallets and their lead time.

    The index is the sum of squared shares within the ten; the list is ordered by notional.
    """
    return _top_wallets(aligned_wallets(trades, refs))


def _top_wallets(aligned: DataFrame) -> DataFrame:
    top = top_n(aligned, ["market_id"], [F.desc("notional"), "address"], 10)
    n = F.col("notional").cast("decimal(18,6)")
    agg = top.groupBy("market_id").agg(
        F.sum((n * n).cast("decimal(38,12)")).alias("_sq"), F.sum(n).alias("_s"),
        F.sort_array(F.collect_list(F.struct(
            "rank", "address", minutes_between(F.col("t_news"), F.col("first_trade_ts")).alias("minutes_before_news"),
            F.col("notional").cast("double").alias("notional_usdc")))).alias("_list"))
    hhi = F.bround(F.try_divide(F.col("_sq").cast("double"), F.pow(F.col("_s").cast("double"), 2)), 6)
    return agg.select(
        "market_id", F.when(F.col("_s") > 0, hhi).cast("decimal(8,6)").alias("wallet_hhi_top10"),
        F.transform("_list", lambda x: F.struct(x["address"].alias("address"),
                                                x["minutes_before_news"].alias("minutes_before_news"),
                                                x["notional_usdc"].alias("notional_usdc")))
        .alias("time_to_news_top10"))


def wallet_first_seen(trades: DataFrame) -> DataFrame:
    """Earliest trade of each address, as taker or maker."""
    addr = F.explode(F.array("taker_address", "maker_address"))
    return (trades.select(addr.alias("address"), "ts").where("address is not null and address <> ''")
            .groupBy("address").agg(F.min("ts").alias("first_seen")))


def funding_sources(transfers: DataFrame) -> DataFrame:
    """Ten largest senders per receiving wallet, addresses compared without case."""
    from tidemark.functions.numeric import usdc
    by = (transfers.groupBy(F.lower("to_address").alias("address"), F.lower("from_address").alias("counterparty"))
          .agg(F.count("*").alias("n_transfers"), F.sum(usdc(F.col("value_units"))).alias("total_usdc")))
    return top_n(by, ["address"], [F.desc("total_usdc"), "counterparty"], 10)

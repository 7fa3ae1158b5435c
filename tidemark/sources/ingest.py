"""Landed raw payloads to typed tables. Each input is a table of text lines with an ingest number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.functions.numeric import usdc
from tidemark.sources.upsert import keep_first

MONEY, PRICE6 = "decimal(20,6)", "decimal(8,6)"


#: fields of a market line, taken out of its VARIANT in one pass; each is NULL where it is missing or of another kind
_MARKET = "struct<" + ", ".join(f"{n}: string" for n in (
    "conditionId", "id", "question", "description", "groupItemTitle", "createdAt", "startDate", "endDate", "closedTime", "outcomePrices",
    "volume", "liquidity", "slug", "clobTokenIds")) + ", events: array<struct<title: string>>>"


def markets(raw: DataFrame) -> DataFrame:
    """Market lines (ingest_no, line) to one row per market, the first line winning. A line is parsed once, into a VARIANT; broken lines are left out."""
    # the place settles equal numbers; as it is no function of the row, Spark doesn't move the filter on ids before the parse and parse once more
    m = raw.select("ingest_no", F.monotonically_increasing_id().alias("at"), P.field(P.payload(F.col("line")), "$", _MARKET).alias("p"))
    g = lambda name: F.col(f"p.{name}")
    one = lambda *names: F.coalesce(*[P.blank_to_null(g(n)) for n in names])
    df = m.select(
        "ingest_no", "at", one("conditionId", "id").alias("market_id"), F.coalesce(g("question"), F.lit("")).alias("question"),
        g("description").alias("description"), F.coalesce(F.coalesce(P.blank_to_null(F.get("p.events", F.lit(0))["title"]), one("groupItemTitle")), F.lit("")).alias("category_raw"),
        P.parse_iso_ts(one("createdAt", "startDate")).alias("t_open"), P.parse_iso_ts(g("endDate")).alias("end_date"),
        P.parse_iso_ts(g("closedTime")).alias("t_resolve"), P.outcome_from_prices(one("outcomePrices")).alias("outcome"),
        g("volume").try_cast(MONEY).alias("volume"), g("liquidity").try_cast(MONEY).alias("liquidity"), one("slug").alias("slug"),
        P.token_at(one("clobTokenIds")).alias("yes_token"))
    return keep_first(df.where("market_id is not null"), ["market_id"], ["ingest_no", "at"]).drop("ingest_no", "at")


def quotes(raw: DataFrame) -> DataFrame:
    """Quote pages (ingest_no, market_id, line) to one price per (market, minute), the first quote winning."""
    hist = F.from_json("line", "history array<struct<t: bigint, p: string>>")
    df = (raw.select("ingest_no", "market_id", F.posexplode(hist["history"]).alias("pos", "q"))
          .select("ingest_no", "pos", "market_id", F.date_trunc("minute", F.timestamp_seconds("q.t")).alias("ts"),
                  F.col("q.p").try_cast(PRICE6).alias("mid_price")))
    return keep_first(df, ["market_id", "ts"], ["ingest_no", "pos"]).drop("ingest_no", "pos")


_FILL = ("id string, timestamp string, transactionHash string, maker struct<id: string>, taker struct<id: string>, "
         "side string, size string, price string")


def _fill_columns(f, log_index):
    size, price = usdc(f["size"].try_cast("bigint")), f["price"].try_cast(PRICE6)
    return [f["transactionHash"].alias("tx_hash"), log_index.alias("log_index"),
            F.timestamp_seconds(f["timestamp"].try_cast("bigint")).alias("ts"),
            F.lower(F.coalesce(f["taker"]["id"], F.lit(""))).alias("taker_address"),
            P.blank_to_null(F.lower(f["maker"]["id"])).alias("maker_address"),
            P.side_normalise(f["side"]).alias("side"), size.cast(MONEY).alias("size_shares"), price.alias("price"),
            F.round(size.cast(MONEY) * price, 6).cast(MONEY).alias("notional_usdc")]


def fills(raw: DataFrame, outcome_index: int = 1) -> DataFrame:
    """Order fills (ingest_no, market_id, line) to trades, one per (tx_hash, log_index), the first winning."""
    f = F.from_json("line", _FILL)
    df = raw.select("ingest_no", "market_id", f.alias("f"))
    out = df.select("ingest_no", "market_id", *_fill_columns(F.col("f"), P.log_index(F.col("f.id"))),
                    F.lit(outcome_index).alias("outcome_index"))
    return keep_first(out, ["tx_hash", "log_index"], ["ingest_no"]).drop("ingest_no")


def alternate_fills(raw: DataFrame, outcome_index: int = 1) -> DataFrame:
    """Fills of a feed without log index: a digest of the row stands in for it."""
    df = raw.select("ingest_no", "market_id", F.from_json("line", _FILL).alias("f"))
    idx = P.pseudo_log_index(F.col("f.transactionHash"), F.lower("f.taker.id"), F.col("f.size"), F.col("f.price"),
                             F.col("f.timestamp"))
    out = df.select("ingest_no", "market_id", *_fill_columns(F.col("f"), idx), F.lit(outcome_index).alias("outcome_index"))
    return keep_first(out, ["tx_hash", "log_index"], ["ingest_no"]).drop("ingest_no")


def new_fills(loaded: DataFrame, existing: DataFrame) -> DataFrame:
    """Loaded trades that are not stored yet."""
    return loaded.join(existing.select("tx_hash", "log_index"), ["tx_hash", "log_index"], "left_anti")


def resolutions(requests: DataFrame, markets_df: DataFrame) -> DataFrame:
    """Settled oracle requests to one resolution per market named in their text.

    The id is taken out of the text, so the match is an equality join and not a text search per market.
    """
    text = P.decode_hex_text(F.col("ancillary_hex"))
    r = (requests.where("settled").withColumn("_text", text)
         .withColumn("market_id", F.explode(F.array_distinct(P.embedded_ids(F.lower("_text"))))))
    r = r.join(markets_df.select("market_id"), "market_id", "left_semi").select(
        "num", "market_id", F.timestamp_seconds("resolve_timestamp").alias("t_resolve"),
        P.outcome_from_oracle_price(F.col("resolved_price")).alias("outcome"),
        P.pick_evidence_url(F.col("_text")).alias("evidence_url"), P.blank_to_null(F.lower("proposer")).alias("proposer"))
    return keep_first(r, ["market_id"], ["num"]).drop("num")


def incoming_transfers(transfers: DataFrame) -> DataFrame:
    """Per receiving wallet: number, amount and first time of incoming transfers."""
    return transfers.groupBy(F.lower("to_address").alias("address")).agg(
        F.count("*").alias("n_transfers"), F.sum(usdc(F.col("value_units"))).alias("total_usdc"), F.min("ts").alias("first_seen_chain_at"))

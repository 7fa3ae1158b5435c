"""Streaming forms of the incremental steps: trade dedupe, minute VWAP, first sightings, quote upserts.

Every function takes a streaming (or batch) table of typed rows and returns the transformed one, or
a ``foreachBatch`` writer. Results over the same rows equal the batch operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.functions.numeric import PRICE, clamp01, ratio
from tidemark.operators.features import wallet_first_seen
from tidemark.sources.upsert import keep_first
from tidemark.streaming.segments import Segments


def dedupe_trades(trades: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First copy of each (tx_hash, log_index); state is dropped once the watermark has passed."""
    return trades.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["tx_hash", "log_index"])


@dataclass(frozen=True)
class Landing:
    """Trades as they arrive, each once: those whose minute was closed by earlier batches go to the late side, all others on.

    Below ``path``, ``rows/b=<batch>/late=<false|true>`` holds the batch's rows, and ``done/b=<batch>`` its greatest time and number of late rows.
    A minute is closed when its end is no later than the watermark, the greatest time of earlier batches less ``lateness``. The watermark is
    read from written batches alone, so a batch that is run again splits as before, and one that is whole is not written twice.
    """

    spark: SparkSession
    path: str
    lateness: str = "1 hour"

    def _done(self, before: int | None = None) -> DataFrame:
        t = self.spark.read.schema("top timestamp, n_late bigint, b bigint").parquet(f"{self.path}/done")
        return t if before is None else t.where(F.col("b") < before)

    def create(self) -> Landing:
        self.spark.createDataFrame([], "top timestamp, n_late bigint").write.parquet(f"{self.path}/done/b=-1")
        return self

    def watermark(self, before: int | None = None):
        """The watermark after all batches, or after those before a batch; None before the first."""
        return self._done(before).agg((F.max("top") - F.expr(f"interval {self.lateness}")).alias("w")).first()["w"]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` step."""
        if not self._done().where(F.col("b") == batch_id).isEmpty():
            return
        mark = self.watermark(batch_id)
        closed = F.lit(False) if mark is None else F.date_trunc("minute", "ts") + F.expr("interval 1 minute") <= F.lit(mark)
        seen = Observation()
        rows = batch.withColumn("late", F.coalesce(closed, F.lit(False))).observe(seen, F.max("ts").alias("top"), F.count_if("late").alias("n_late"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/b={batch_id}")
        top = seen.get
        self.spark.createDataFrame([(top["top"], top["n_late"])], "top timestamp, n_late bigint").write.mode("overwrite").parquet(f"{self.path}/done/b={batch_id}")

    def _schema(self, trades: StructType) -> StructType:
        return StructType([*trades.fields, StructField("b", LongType()), StructField("late", BooleanType())])

    def on_time(self, trades: StructType) -> DataFrame:
        """The on-time side as a stream; its files come in order of batches, so none of its rows is late for the same lateness."""
        return self.spark.readStream.schema(self._schema(trades)).parquet(f"{self.path}/rows").where("not late").drop("b", "late")

    def rows(self, trades: StructType, late: bool) -> DataFrame:
        """One side as a table, with the batch ``b`` of each row."""
        return self.spark.read.schema(self._schema(trades)).parquet(f"{self.path}/rows").where(F.col("late") == late).drop("late")

    def late_count(self) -> int:
        return self._done().agg(F.coalesce(F.sum("n_late"), F.lit(0))).first()[0]


def minute_sums(trades: DataFrame, lateness: str | None = None) -> DataFrame:
    """Volume and shares per (market, minute); of a stream with a lateness, those of closed minutes."""
    if lateness:
        trades = trades.withWatermark("ts", lateness)
    g = trades.groupBy("market_id", F.window("ts", "1 minute").alias("w")).agg(F.sum("notional_usdc").alias("volume"), F.sum("size_shares").alias("shares"))
    return g.select("market_id", F.col("w.start").alias("ts"), "volume", "shares")


def minute_prices(sums: DataFrame) -> DataFrame:
    """Sums that may come in parts to one price per (market, minute)."""
    g = sums.groupBy("market_id", "ts").agg(F.sum("volume").alias("volume"), F.sum("shares").alias("shares"))
    return g.select("market_id", "ts", F.when(F.col("shares") > 0, clamp01(ratio(F.col("volume"), F.col("shares")))).cast(PRICE).alias("mid_price"), "volume")


def all_minutes(closed: DataFrame, landing: Landing, trades: StructType) -> DataFrame:
    """Prices of all minutes once the streams have caught up: closed sums, with what came late for them, and the minutes that are still open."""
    mark = landing.watermark()
    tail = landing.rows(trades, False)
    if mark is not None:  # the rest of the on-time side is in the closed minutes
        tail = tail.where(F.date_trunc("minute", "ts") + F.expr("interval 1 minute") > F.lit(mark))
    return minute_prices(closed.unionByName(minute_sums(tail)).unionByName(minute_sums(landing.rows(trades, True))))


def _log_writer(path: str, prepare):
    """foreachBatch writer of an append-only log: each batch writes its own reduced rows, once, under its number.

    The cost of a batch follows the batch and not the table, and a batch that is run again replaces
    its own folder. Readers merge by key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/b={batch_id}")
    return write


def first_seen_writer(path: str):
    """First sighting per address within each batch."""
    return _log_writer(path, wallet_first_seen)


def read_first_seen(spark: SparkSession, path: str) -> DataFrame:
    """Running minimum over all batches."""
    return spark.read.parquet(path).groupBy("address").agg(F.min("first_seen").alias("first_seen"))


def quote_rows(batch: DataFrame) -> DataFrame:
    """Price per (market, minute) of a batch; inside it the first quote wins, as in the batch load."""
    m = batch.select("ingest_no", "market_id", F.date_trunc("minute", "ts").alias("ts"), "mid_price")
    return keep_first(m, ["market_id", "ts"], ["ingest_no"]).drop("ingest_no")


def quote_writer(segments: Segments):
    """``foreachBatch`` writer of a batch's segment; the last batch that holds a minute wins."""
    return lambda batch, batch_id: segments.append(quote_rows(batch), batch_id)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode Parquet sink over everything available now."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_merge(stream: DataFrame, writer, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(writer).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

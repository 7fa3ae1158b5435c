"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SCHEMA = ("market_id string, status string, t_event string, confidence double, provider string, "
                     "estimated_cost_usd double")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an orderable place ``line_no``: file, start of the split in it, and the line's place in the split.

    Spark packs splits into partitions by size, so a number that follows partitions alone would not follow files.
    A split is read by one task in line order, so its lines are ordered among themselves.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(place.alias("line_no"), F.col("value").alias("line"))


def tolerant_records(lines: DataFrame, accept: Column | None = None) -> DataFrame:
    """Checkpoint lines (line_no, line) to the last well-formed record per market.

    Broken lines and lines without a market id are skipped. ``accept`` filters records before the
    last one is chosen.
    """
    rec = F.from_json("line", CHECKPOINT_SCHEMA + ", _corrupt string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = lines.select("line_no", rec.alias("r")).where("r._corrupt is null and r.market_id is not null") \
        .select("line_no", "r.*").drop("_corrupt").withColumn("t_event", F.try_to_timestamp("t_event"))
    if accept is not None:
        df = df.where(accept)
    cols = [c for c in df.columns if c != "market_id"]
    return df.groupBy("market_id").agg(F.max(F.struct(*cols)).alias("r")).select("market_id", "r.*")


def remaining(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates without a finished record."""
    return candidates.join(done.select("market_id"), "market_id", "left_anti")


def typology_rows(markets: DataFrame, counts: DataFrame, cutoff: Column) -> DataFrame:
    """Public rows: markets opened up to the cutoff (or without opening) with their trade counts."""
    from tidemark.functions.parsing import format_iso
    df = markets.where(F.col("t_open").isNull() | (F.col("t_open") <= cutoff)).join(counts, "market_id", "left")
    return df.select(
        "market_id", "question", "description", "category", "resolution_type", F.col("outcome").cast("byte").alias("resolution_outcome"),
        F.col("volume").cast("double").alias("volume_total_usdc"), format_iso(F.col("t_open")).alias("created_at"),
        format_iso(F.col("end_date")).alias("closed_at"), format_iso(F.col("t_resolve")).alias("resolved_at"),
        F.coalesce("n_trades", F.lit(0)).cast("int").alias("n_trades_in_db")).orderBy(F.asc_nulls_last("created_at"), "market_id")


def write_typology(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/parquet")
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/jsonl")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, Parquet or JSON lines."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "parquet": lambda: w.parquet(path), "json": lambda: w.json(path)}[fmt]()


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """One ledger row per finished job."""
    schema = "collector string, started_at timestamp, finished_at timestamp, status string, target string, n_records bigint, error_message string"
    spark.createDataFrame([tuple(run.get(c.split()[0]) for c in schema.split(", "))], schema).write.mode("append").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def fixture_rows(sample: DataFrame) -> DataFrame:
    """Benchmark rows in their published camel-case schema."""
    from tidemark.functions.parsing import format_iso
    return sample.select(
        F.col("market_id").alias("marketId"), "question", F.col("topic").alias("category"), F.col("category").alias("categoryRule"),
        F.col("outcome").alias("resolutionOutcome"), format_iso(F.col("t_resolve")).alias("resolvedAt"),
        format_iso(F.col("cutoff")).alias("baselineDate"), F.round(F.col("baseline_price").cast("double"), 6).alias("baselineMidPrice"),
        F.col("baseline_source").alias("baselineSource"), F.col("volume").cast("double").alias("volumeUsdc"),
        F.col("n_trades").alias("tradeCount"), F.lit(None).cast("double").alias("ilsScore"),
        F.col("event_group").alias("eventGroupId"), F.col("is_bucket_market").alias("isBucketMarket"))

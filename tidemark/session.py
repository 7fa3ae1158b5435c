"""Session settings shared by jobs and tests."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time; sizes are left to the cluster unless given."""
    b = (SparkSession.builder.appName("tidemark")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Fix the session clock to UTC; every timestamp in the data is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def stage_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder; a temporary one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and go on from the written table.

    This cuts the lineage, survives lost executors, and gives the branches a columnar table of known
    size instead of a plan that would be run once per branch.
    """
    path = stage_folder(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

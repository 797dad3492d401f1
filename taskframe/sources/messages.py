"""Message and log files as tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.schemas import raw_messages
from taskframe.session import scratch_dir


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw queue rows from JSON lines or Parquet, with a fixed schema."""
    return spark.read.schema(raw_messages()).format(fmt).load(path)


def stream_messages(spark: SparkSession, path: str, fmt: str = "json",
                    files_per_batch: int = 1000) -> DataFrame:
    """The same rows as they land."""
    return (
        spark.readStream.schema(raw_messages()).format(fmt)
        .option("maxFilesPerTrigger", files_per_batch).load(path))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_log_lines(spark: SparkSession, records: DataFrame) -> str:
    """Log records as JSON lines in a new folder."""
    folder = scratch_dir(spark, "logs")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "level", "logger", "msg", "job_id", "seq"))
    records.select(line.alias("value")).write.text(folder)
    return folder

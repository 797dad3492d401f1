"""Objects of a store as rows: listing, bounded reads, JSON documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.functions.json_values import computed_once, strict_json
from taskframe.functions.paths import EXTENSION_TYPES, content_type, has_extension
from taskframe.schemas import MAX_READ_BYTES
from taskframe.session import scratch_dir


class Objects(NamedTuple):
    read: DataFrame
    refused: DataFrame


class JsonObjects(NamedTuple):
    parsed: DataFrame
    malformed: DataFrame
    refused: DataFrame


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size, time and content type; contents are not read."""
    return _files(spark, folder).select(
        "path", F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        content_type(F.col("path")).alias("content_type"))


def read_objects(spark: SparkSession, folder: str, max_bytes: int = MAX_READ_BYTES,
                 extensions=tuple(EXTENSION_TYPES)) -> Objects:
    """Contents of the objects with an allowed extension, up to a size, and the
    others with the reason they are refused.

    Refused objects are never opened: the limit is a filter on the length that
    the source applies before it reads, and their branch asks for no content.
    """
    files = _files(spark, folder)
    allowed = F.coalesce(has_extension(F.col("path"), extensions), F.lit(False))
    reason = F.when(~allowed, "extension").when(F.col("length") > max_bytes, "too_large")
    return Objects(
        read=files.filter((F.col("length") <= max_bytes) & allowed).select(
            "path", F.col("length").alias("size"),
            content_type(F.col("path")).alias("content_type"), "content"),
        refused=files.select("path", F.col("length").alias("size"), reason.alias("reason"))
        .filter("reason is not null"))


def read_json_objects(spark: SparkSession, folder: str,
                      max_bytes: int = MAX_READ_BYTES) -> JsonObjects:
    """Objects parsed as `doc` (VARIANT), those that are not one JSON value, and
    those that are not opened, with the reason."""
    rows, refused = read_objects(spark, folder, max_bytes, extensions=(".json",))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    parsed = computed_once(rows.select("path", "size", text.alias("_text")),
                           doc=strict_json(F.col("_text")))
    return JsonObjects(
        parsed=parsed.filter("doc is not null").select("path", "doc"),
        malformed=parsed.filter("doc is null").select("path", "size"),
        refused=refused)


def hourly_objects(spark: SparkSession, events: DataFrame) -> str:
    """Write one JSON object per hour of events; returns the folder.

    Demonstration input for the scans: as many objects as the events span
    hours, each of them one line.
    """
    folder = scratch_dir(spark, "objects")
    hours = events.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
    hours.write.option("maxRecordsPerFile", 1).json(folder)
    return folder

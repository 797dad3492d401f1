"""Artifacts and messages written so that a reader sees whole runs only.

Contents go to a table partitioned by step, and what is known about each to a
manifest without contents; one commit makes both visible.  Messages go to a
table partitioned by queue in the same way.  A run that stops earlier leaves
folders that no reader opens; the next attempt writes its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.operators.layout import result_layout
from taskframe.schemas import MAX_WRITE_BYTES, TASK_KEY
from taskframe.sources import commits

KEPT = ("uri", "mime", "shape", "list_pos", "list_size", "file_pos", "kind", "size_bytes", "sha256")


class Written(NamedTuple):
    manifest: DataFrame
    refused: DataFrame


def with_digests(items: DataFrame) -> DataFrame:
    """Items with the size and checksum of their content, whatever they said of it."""
    return items.withColumns({
        "size_bytes": F.octet_length("content").cast("bigint"), "sha256": F.sha2("content", 256)})


def write_results(items: DataFrame, dag, base: str, id: str, max_bytes: int = MAX_WRITE_BYTES) -> Written:
    """Lay out items with `content` and write them under a commit id.

    JSON items hold their UTF-8 text.  Gives the manifest of the run and the items
    that were refused, without contents.  A run under an id that is committed
    already writes nothing.
    """
    spark = items.sparkSession
    commits.create(spark, base)
    laid = result_layout(with_digests(items), dag, max_bytes)
    if not commits.has(spark, base, id):
        folders = {n: commits.new_folder(base, n) for n in ("results", "manifest", "refused")}
        number = commits.next_number(spark, base)
        whole = laid.written.select(
            *TASK_KEY, *KEPT, F.lit(number).cast("bigint").alias("commit"), F.lit(id).alias("run"), "content")
        whole.write.partitionBy("step").parquet(folders["results"])
        # From what was written, not computed a second time.
        stored = spark.read.schema(whole.schema).parquet(folders["results"])
        stored.drop("content").write.parquet(folders["manifest"])
        laid.refused.drop("content").write.parquet(folders["refused"])
        commits.commit(spark, base, id, folders, number=number)
    mine = {e.name: e.folder for e in commits.live(spark, base) if e.id == id}
    return Written(spark.read.parquet(mine["manifest"]), spark.read.parquet(mine["refused"]))


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """One row per URI: its last write."""
    rows = commits.read(spark, base, "manifest")
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "uri"]), F.struct("commit", "run"))
    return rows.groupBy("uri").agg(last.alias("row")).select("uri", "row.*")


def read_results(spark: SparkSession, base: str, step: str | None = None) -> DataFrame:
    """Contents of the last write of every URI, of one step or of all.

    A step reads its own partitions only.
    """
    manifest = read_manifest(spark, base)
    stored = commits.read(spark, base, "results", T.StructType([*manifest.schema, T.StructField("content", T.BinaryType())]))
    if step is not None:
        manifest, stored = manifest.where(F.col("step") == step), stored.where(F.col("step") == step)
    last = manifest.select("uri", "commit", "run")
    return stored.join(last, ["uri", "commit", "run"], "left_semi")


def write_messages(messages: DataFrame, base: str, id: str) -> None:
    """Write outgoing messages by queue under a commit id."""
    spark = messages.sparkSession
    commits.create(spark, base)
    if not commits.has(spark, base, id):
        folder = commits.new_folder(base, "messages")
        messages.write.partitionBy("queue").parquet(folder)
        commits.commit(spark, base, id, {"messages": folder})


def read_messages(spark: SparkSession, base: str, queue: str | None = None) -> DataFrame:
    rows = commits.read(spark, base, "messages")
    return rows if queue is None else rows.where(F.col("queue") == queue)

"""Folders of data that become visible together.

Data is written to folders of its own that nobody reads yet.  A commit is one
small file of rows that name such folders, by table; readers go through these
rows alone.  So folders of failed, half-written or repeated runs are never seen,
and the tables of one commit appear at once.

A base is a commit that stands for the commits it covers.  Those stay readable
for readers that have planned already, until `expire` removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG, ATTEMPT = "commits", "attempt"
SCHEMA = "id string, number bigint, name string, folder string, covers array<string>"


@dataclass(frozen=True)
class Entry:
    """One table's folder of a commit."""

    id: str
    number: int
    name: str
    folder: str


def new_folder(base: str, name: str) -> str:
    """A folder below a table's that no other attempt uses."""
    return f"{base}/{name}/{ATTEMPT}={uuid.uuid4().hex}"


def create(spark: SparkSession, base: str) -> None:
    """An empty log, if there is none."""
    spark.range(0).selectExpr(
        "cast(null as string) id", "id as number", "cast(null as string) name", "cast(null as string) folder",
        "cast(null as array<string>) covers").coalesce(1).write.mode("ignore").parquet(f"{base}/{LOG}")


def _log(spark: SparkSession, base: str) -> list:
    """All commit rows: as many as tables times commits since the last `expire`."""
    return spark.read.schema(SCHEMA).parquet(f"{base}/{LOG}").where("id is not null").collect()


def has(spark: SparkSession, base: str, id: str) -> bool:
    return any(r.id == id for r in _log(spark, base))


def next_number(spark: SparkSession, base: str) -> int:
    return max((r.number for r in _log(spark, base)), default=-1) + 1


def commit(spark: SparkSession, base: str, id: str, folders: dict[str, str], covers: Sequence[str] = (),
           number: int | None = None) -> None:
    """Make folders visible, by table name, in one file.

    An id that is committed already stays as it is.  `number` orders commits; by
    default it is one more than the largest.
    """
    rows = _log(spark, base)
    if any(r.id == id for r in rows):
        return
    if number is None:
        number = max((r.number for r in rows), default=-1) + 1
    if not folders:
        raise ValueError("a commit names one folder at least")
    covered = F.array(*map(F.lit, covers)).cast("array<string>")
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("folder")) for n, f in sorted(folders.items())])
    made = spark.range(1).select(F.lit(id).alias("id"), F.lit(number).cast("bigint").alias("number"),
                                 F.inline(entries).alias("name", "folder"), covered.alias("covers"))
    made.coalesce(1).write.mode("append").parquet(f"{base}/{LOG}")


def live(spark: SparkSession, base: str, name: str | None = None) -> list[Entry]:
    """What no later base covers, in commit order, of one table or of all.

    Of an id that two writers committed at once, one of the two counts.
    """
    rows = _log(spark, base)
    covered = {c for r in rows for c in r.covers or ()}
    first: dict[tuple[str, str], Entry] = {}
    for r in sorted(rows, key=lambda r: (r.number, r.id, r.folder)):
        if r.id not in covered and name in (None, r.name):
            first.setdefault((r.id, r.name), Entry(r.id, r.number, r.name, r.folder))
    return list(first.values())


def read(spark: SparkSession, base: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of all live folders of a table.

    Without any the table is empty, in the given schema.
    """
    folders = [e.folder for e in live(spark, base, name)]
    if folders:
        reader = spark.read if schema is None else spark.read.schema(schema)
        # Folders partitioned by a column are parts of one table.
        return reader.option("basePath", f"{base}/{name}").parquet(*folders).drop(ATTEMPT)
    if schema is None:
        raise FileNotFoundError(f"nothing committed for {name} in {base}")
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def expire(spark: SparkSession, base: str) -> int:
    """Remove the folders of covered commits; their number.

    Their commit rows stay, so a repeated batch is still known.  Folders that no
    commit names may belong to a run that goes on, and stay too.
    """
    rows = _log(spark, base)
    current = {e.folder for e in live(spark, base)}
    gone = sorted({r.folder for r in rows} - current)
    jvm = spark._jvm
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return len(gone)

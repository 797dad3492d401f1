"""What the operators of this subpackage share: Arrow column maps, word rules, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.session import scratch_dir

# Characters between words: space and the controls 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
# Rows of an Arrow batch are handed on in slices of about so many bytes, so
# that a batch of very long texts is not held as Python objects at once.
SLICE_BYTES = 2 << 20


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def others(df: DataFrame, new: list[str]) -> list[str]:
    """The frame's columns without those that new columns of these names replace."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


# What a worker process has learned for one operator; see `kept`.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """State that outlives a task in its worker process, of one operator at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def map_columns(df: DataFrame, inputs: list[str], outputs: T.StructType,
                start: Callable[[], Callable[..., list]], keeps: bool = False) -> DataFrame:
    """The frame with further columns that Python computes from Arrow columns.

    `start` runs once per task and returns the function from the input columns
    (Arrow arrays) to the output columns (Arrow arrays or lists).  Input columns
    named as an output are replaced.  Unless `start` uses `kept`, a worker drops
    what it keeps of other operators.
    """
    keep = others(df, outputs.fieldNames())
    place = {c: i for i, c in enumerate(keep)}
    extra = [c for c in inputs if c not in place]
    sent = df.select(*[col(c) for c in keep], *[col(c).alias(f"in {i}") for i, c in enumerate(extra)])
    at = [place[c] if c in place else len(keep) + extra.index(c) for c in inputs]
    schema = T.StructType([df.schema[c] for c in keep] + list(outputs.fields))
    names, n_keep = schema.fieldNames(), len(keep)
    kinds = [_arrow_type(f.dataType) for f in outputs.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        compute = start()
        for batch in batches:
            for part in slices(batch):
                made = compute(*[part.column(i) for i in at])
                made = [m if isinstance(m, pa.Array) else pa.array(m, kind)
                        for m, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_keep)] + made, names)

    return sent.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# Where `written` notes its tables, inside of `noted`.
_notes: list[list[str]] = []


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Adds the scratch tables written meanwhile to `paths`."""
    _notes.append(paths)
    try:
        yield
    finally:
        _notes.pop()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared scratch folder, so that nothing before it runs again."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    for paths in _notes:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(paths: list[str], still_read: DataFrame) -> None:
    """Remove scratch tables, but for those that the frame reads; removed ones leave the list."""
    spark = still_read.sparkSession
    files = still_read.inputFiles()
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths.copy():
        if not any(path.rsplit("/", 1)[1] in f for f in files):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            paths.remove(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A unique long per row.  Only stable once the frame is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

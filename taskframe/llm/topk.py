"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are packed into blocks.  A block of queries, of bounded
size, meets all candidate blocks: each pass scores everything and counts the
scores of each query in equal bins of its open range.  A task reports only its
bins from the top down to its own kth score, since the kth score of all rows is
no lower.  The summed counts show the bin that holds the kth score, which becomes
the next range, until a bin is one score wide.  A last pass keeps what reaches
that score, breaking ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from taskframe.llm.frames import col, written

# Queries of one pass, rows of a candidate block, bins of a histogram.
QUERY_ROWS, BLOCK_ROWS, BINS = 2048, 1024, 512
# Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


def whole_vectors(df: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """Columns id and v: floor(scale * x) of each component as double.

    Rows are left out whose vector or id is null, or that hold a null or
    non-finite component.
    """
    x = F.transform(col(vector).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(col(id).isNotNull() & col(vector).isNotNull()).select(
        col(id).cast("long").alias("id"), x.alias("x")).where(~bad).select(
        "id", F.transform("x", lambda c: F.floor(c).cast("double")).alias("v"))


_BLOCK = T.StructType([
    T.StructField("rows", T.LongType()), T.StructField("width", T.LongType()),
    T.StructField("peak", T.DoubleType()), T.StructField("ids", T.BinaryType()),
    T.StructField("data", T.BinaryType())])


def blocks(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """The vectors packed into matrices of one width, with the largest norm of each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[list[float]]]] = {}

        def made(width: int) -> pa.RecordBatch:
            ids, data = held.pop(width)
            x = np.array(data, "<f8").reshape(len(ids), width)
            peak = float(np.sqrt((x * x).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([
                pa.array([len(ids)]), pa.array([width]), pa.array([peak]),
                pa.array([np.array(ids, "<i8").tobytes()]), pa.array([x.tobytes()])], _BLOCK.fieldNames())

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, data = held.setdefault(len(v), ([], []))
                ids.append(i)
                data.append(v)
                if len(ids) == rows:
                    yield made(len(v))
        for width in list(held):
            yield made(width)

    return vectors.select("id", "v").mapInArrow(pack, _BLOCK)


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["data"], "<f8").reshape(len(ids), row["width"])


def _scored(batches: Iterator[pa.RecordBatch], shared):
    """The scores of all queries with each candidate block."""
    ids, data, low, high = shared.value
    for batch in batches:
        for row in batch.to_pylist():
            other, x = _matrix(row)
            score = (data @ x.T).astype(np.int64)
            # A row is no candidate of itself.
            score[ids[:, None] == other[None, :]] = -EXACT - 1
            yield ids, other, score, low, high


class _Pass:
    """One block of queries against all candidate blocks of their width."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, candidates: DataFrame, k: int, peak: float) -> None:
        self.k, self.spark = k, candidates.sparkSession
        self.candidates = candidates.where(F.col("width") == data.shape[1])
        bound = np.ceil(np.sqrt((data * data).sum(axis=1)) * peak) + 1
        if float(bound.max(initial=0)) >= EXACT:
            raise OverflowError("inner products beyond 2**53 are not exact here")
        self.ids, self.data = ids, data
        self.low, self.high = -bound.astype(np.int64), bound.astype(np.int64) + 1

    def narrow(self) -> bool:
        """Cut every query's range to the bin that holds its kth score.  True when done."""
        width = np.maximum(1, -((self.low - self.high) // BINS))
        if (self.high - self.low <= 1).all():
            return True
        k = self.k
        shared = self.spark.sparkContext.broadcast((self.ids, self.data, self.low, self.high))
        step = self.spark.sparkContext.broadcast(width)

        def count(batches):
            n = len(shared.value[0])
            total = np.zeros((n, BINS + 2), np.int64)
            base = np.arange(n)[:, None] * (BINS + 2)
            for _, _, score, low, high in _scored(batches, shared):
                # Bin 0 is below the range, the last above it.
                bin = np.clip((score - low[:, None]) // step.value[:, None] + 1, 0, BINS + 1)
                bin[score >= high[:, None]] = BINS + 1
                total += np.bincount((base + bin).ravel(), minlength=total.size).reshape(total.shape)
            from_top = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            query, bin = np.nonzero((total > 0) & (from_top < k))
            inside = bin > 0
            query, bin = query[inside], bin[inside]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(bin), pa.array(total[query, bin])], ["query", "bin", "n"])

        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        sums = self.candidates.mapInArrow(count, "query long, bin long, n long").groupBy("query", "bin").agg(
            F.sum("n").alias("n"))
        found = sums.withColumn("upto", F.sum("n").over(down)).where(
            (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("query", "bin").collect()
        hit = np.zeros(len(self.ids), bool)
        for r in found:
            q, b = r["query"], r["bin"]
            hit[q] = True
            # The bin above the range holds the kth score of no query: it was found inside before.
            self.low[q] += (b - 1) * width[q]
            self.high[q] = min(self.high[q], self.low[q] + width[q])
        # Fewer than k candidates: all count.
        self.high[~hit] = self.low[~hit] + 1
        shared.unpersist()
        step.unpersist()
        return False

    def reaching(self) -> DataFrame:
        """Candidates that reach each query's kth score, at most k per query and task."""
        k = self.k
        shared = self.spark.sparkContext.broadcast((self.ids, self.data, self.low, self.high))

        def keep(batches):
            best: dict[int, list[tuple[int, int]]] = {}
            for ids, other, score, low, _ in _scored(batches, shared):
                query, at = np.nonzero(score >= low[:, None])
                for q, s, i in zip(query.tolist(), score[query, at].tolist(), other[at].tolist()):
                    best.setdefault(q, []).append((-s, i))
                for q in set(query.tolist()):
                    best[q] = sorted(best[q])[:k]
            rows = [(int(shared.value[0][q]), q, i, -s) for q, kept in best.items() for s, i in kept]
            columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["query_id", "query", "vec_id", "score"])

        return self.candidates.mapInArrow(keep, "query_id long, query long, vec_id long, score long")


def _ranked(rows: DataFrame, k: int, *groups: str) -> Column:
    return F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), "vec_id"))


def top_k(df: DataFrame, queries: Column, k: int, id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of each query.

    `queries` says which rows are queries; all rows with other ids are their
    candidates, of the same number of components.  Scores are inner products of
    the whole-number vectors, ties go to the smaller id.  Rows without a usable
    vector or id take no part.  Repeated rows count as often as they occur; a
    repeated query is answered once per row.  A query without candidates gives no
    row.  Inner products whose bound reaches 2**53 raise OverflowError.
    """
    spark = df.sparkSession
    candidates = written(blocks(whole_vectors(df, id, vector, scale)), "vectors")
    peak = candidates.agg(F.max("peak")).first()[0] or 0.0
    asked = written(blocks(whole_vectors(df.where(queries), id, vector, scale), QUERY_ROWS), "queries")
    parts: list[DataFrame] = []
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def answer(width: int) -> None:
        """Queries of small blocks are answered together, at most QUERY_ROWS at a time."""
        ids, data = (np.concatenate(x) for x in zip(*held.pop(width)))
        for at in range(0, len(ids), QUERY_ROWS):
            block = _Pass(ids[at:at + QUERY_ROWS], data[at:at + QUERY_ROWS], candidates, k, peak)
            while not block.narrow():
                pass
            rows = block.reaching()
            # At most k rows of each task; a hot tie is cut per salt first.
            salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
            few = salted.withColumn("rank", _ranked(salted, k, "query", "salt")).where(F.col("rank") <= k)
            best = few.withColumn("rank", _ranked(few, k, "query")).where(F.col("rank") <= k)
            parts.append(written(best.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "top"))

    for row in asked.toLocalIterator():
        held.setdefault(row["width"], []).append(_matrix(row))
        if sum(len(i) for i, _ in held[row["width"]]) >= QUERY_ROWS:
            answer(row["width"])
    for width in list(held):
        answer(width)
    result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in parts:
        result = result.union(part)
    return result

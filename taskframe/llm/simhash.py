"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments.  The Manhattan
distance of two such vectors is a lower bound of the number of differing bits,
so two fingerprints within two bits lie within distance two, and the lattice
then has a point within distance one of both.  Every distinct fingerprint is
put into the cells at most one step from its own; fingerprints that meet in a
cell are candidates, and their differing bits are counted exactly.

Cells are read as sorted streams.  One with more than `DENSE` fingerprints, as a
large family of near copies makes it, is not compared pair by pair: its members
go through the same grid with segments of one bit, where the bound is the
distance itself, a cell holds at most 65 fingerprints and all of them are linked.

Only the links needed to connect a cell's members are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from taskframe.llm.components import components
from taskframe.llm.frames import col, free_name, map_columns, others, written

BITS, SEED = 64, 42
# Segments of the embedding; cells with more members than this are refined.
SEGMENTS, DENSE = 16, 64


def _fingerprint(words: list[bytes], n: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(n)))]


def _majorities(rows: list[list[int]]) -> np.ndarray:
    """The bits set in over half of each row's hashes; none for an empty row."""
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros(len(rows), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes = np.array([h for r in rows for h in r], "<u8")
    starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
    counts = np.empty((len(full), BITS), np.int64)
    # Sums of eight bits at a time keep the unpacked bits small.
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        bits = np.unpackbits(raw[:, k:k + 1], axis=1, bitorder="little")
        counts[:, 8 * k:8 * k + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    majority = (2 * counts > sizes[full][:, None]).astype(np.uint64)
    out[full] = (majority << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, name: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """The frame with the 64-bit fingerprint of `text` as a signed long.

    A-Z are lower-cased; words are what lies between ASCII white space.  Fewer
    words than a shingle count as one shingle; a null text and one without words
    have fingerprint zero.
    """

    def start():
        def run(texts):
            rows = [_fingerprint((t or "").encode().lower().split(), shingle) for t in texts.to_pylist()]
            return [pa.array(_majorities(rows).view(np.int64))]
        return run

    return map_columns(df, [text], T.StructType([T.StructField(name, T.LongType())]), start)


def _cells(fp: Column) -> Column:
    """The keys of all cells at most one step from a fingerprint's own."""
    width = BITS // SEGMENTS
    mask = (1 << width) - 1
    shift = mask.bit_length()
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long")))
              for i in range(SEGMENTS)]
    own = sum((F.shiftleft(c.cast("long"), shift * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    near = [own]
    for i, c in enumerate(counts):
        step = F.lit(1 << (shift * i)).cast("long")
        # Cells beyond the possible counts lie between no two fingerprints.
        near += [F.when(c < width, own + step), F.when(c > 0, own - step)]
    return F.array_compact(F.array(*near))


def _spanning(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that connect what is connected within each run of a cell."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live, lag = np.arange(len(cell)), 1
    while len(live):
        live = live[live + lag < len(cell)]
        live = live[cell[live] == cell[live + lag]]
        linked = live[np.bitwise_count(fp[live] ^ fp[live + lag]) <= bits]
        if len(linked):
            found.append((linked, linked + lag))
        lag += 1
    if not found:
        return fp[:0], fp[:0]
    left, right = (np.concatenate(x).tolist() for x in zip(*found))
    root = {}

    def top(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    kept = []
    for i, j in zip(left, right, strict=True):
        a, b = top(i), top(j)
        if a != b:
            root[b] = a
            kept.append((i, j))
    at = np.array(kept, np.int64)
    return fp[at[:, 0]], fp[at[:, 1]]


def _cell_links(bits: int):
    """From rows sorted by cell to links; members of dense cells come out alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.empty(0, np.int64)
        fp = np.empty(0, np.uint64)
        dense = None  # the dense cell being streamed

        def made(a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), b if isinstance(b, pa.Array) else pa.array(b.view(np.int64))],
                ["a", "b"])

        def settle(cell, fp):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            # A run that goes on after a dense one of the same cell is dense too.
            over = (sizes > DENSE) | (cell[starts] == dense if dense is not None else False)
            many = np.repeat(over, sizes)
            if many.any():
                yield made(fp[many], pa.nulls(int(many.sum()), pa.int64()))
            pairs = np.repeat((sizes > 1) & ~over, sizes)
            a, b = _spanning(cell[pairs], fp[pairs], bits)
            if len(a):
                yield made(a, b)

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = cell[-1] if len(cell) else None
            tail = int(np.searchsorted(cell, last)) if len(cell) else 0
            cut = len(cell) if len(cell) - tail > DENSE or last == dense else tail
            if cut:
                yield from settle(cell[:cut], fp[:cut])
                dense = last if cut == len(cell) else None
                cell, fp = cell[cut:], fp[cut:]
        if len(cell):
            yield from settle(cell, fp)

    return run


def _flips(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    flipped = [fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(BITS)]
    return F.array(fp, *flipped)


def links(distinct: DataFrame, fp: str, bits: int = 2) -> DataFrame:
    """Links a, b between distinct fingerprints that connect those within `bits` bits.

    The grid serves one or two bits; zero bits link nothing, as equal
    fingerprints are one row here.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the grid serves distances of up to 2 bits")
    if bits == 0:
        return distinct.select(col(fp).alias("a"), col(fp).alias("b")).limit(0)
    spread = distinct.select(F.explode(_cells(col(fp))).alias("cell"), col(fp).alias("fp"))
    found = written(
        spread.repartition("cell").sortWithinPartitions("cell", "fp")
        .mapInArrow(_cell_links(bits), "a long, b long"), "cell-links")
    # Members of dense cells again, by single bits: with two bits allowed, all
    # around one point are linked; with one bit only those beside the point itself.
    dense = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    around = dense.select(F.explode(_flips(F.col("fp"))).alias("point"), "fp")
    beside = Window.partitionBy("point").orderBy("fp")
    if bits == 2:
        fine = around.select(F.lag("fp").over(beside).alias("a"), F.col("fp").alias("b")).where("a is not null")
    else:
        fine = around.where("point <> fp").join(dense.select(F.col("fp").alias("point")), "point").select(
            F.col("point").alias("a"), F.col("fp").alias("b"))
    return found.where("b is not null").union(fine)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text",
                    shingle: int = 3, bits: int = 2) -> DataFrame:
    """The frame with fingerprint (16 hex digits), component_id and is_first.

    component_id is the smallest id reachable over links of at most `bits`
    differing bits, null only if every id there is null.  is_first marks one row
    of each component: the one with the smallest id, nulls last, and among
    repeated rows any one of them.  Columns of these names are replaced.
    """
    kept = others(df, ["fingerprint", "component_id", "is_first"])
    fp, row = free_name(df, "simhash"), free_name(df, "simhash_row")
    # Written before the rows are numbered, since numbers follow the partitions.
    made = fingerprints(df.select(*map(col, kept)), fp, text, shingle)
    rows = written(made.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(col(id).isNull().alias("none"), col(id).alias("id"), F.col(row).alias("row"))
    distinct = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "distinct")
    roots = components(links(distinct, "fp", bits))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = linked.join(least, "root").select(F.col("fp").alias("of"), "least")
    firsts = distinct.join(of_linked, distinct["fp"] == of_linked["of"], "left").select(
        F.col("fp").alias("of fp"), F.coalesce("least", "first").alias("of all"))
    joined = rows.join(firsts, F.col(fp) == F.col("of fp"))
    return joined.select(
        *map(col, kept), F.lpad(F.lower(F.hex(F.col(fp))), 16, "0").alias("fingerprint"),
        F.col("of all.id").alias("component_id"), (F.col("of all.row") == F.col(row)).alias("is_first"))

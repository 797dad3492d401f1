"""Packing into full windows by non-negative least squares.

Documents longer than a window are cut at its capacity.  What is left to decide
depends on the histogram of piece lengths alone, which has at most `capacity`
entries at any data size.  Shallow combinations of up to three lengths, one of
them repeated, that fill a window exactly are enumerated; how often each is used
is the non-negative solution of least squares against the histogram, rounded
down to what the counts allow.  The residual is packed greedily: combinations
that still fit, then longest first where that fills a window, and what is left is
laid behind one another and cut where a window ends.  The last, partly filled
window is cut into windows whose sizes are powers of two, which need no padding.

A plan is counts of patterns.  Pieces of one length are interchangeable and find
their place by their rank among them, which comes from counts per task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from taskframe.llm.frames import col, free_name, kept, map_columns, others, slices, written
from taskframe.llm.packing import WordIds

# Repeats tried of a length and pairs tried beside them; the residual takes all others.
REPEATS, PARTNERS = 6, 4
STEPS, POWER_STEPS = 400, 30
NEW = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations that fill a window: lengths and repeats, both (n, 3).

    Unused places have repeat zero.  `sizes` ascends.
    """
    have = np.zeros(capacity + 1, np.int64)
    have[sizes] = counts
    found: set[tuple[tuple[int, int], ...]] = set()

    def add(*parts: tuple[int, int]) -> None:
        total: dict[int, int] = {}
        for size, n in parts:
            total[size] = total.get(size, 0) + n
        if all(have[s] >= n for s, n in total.items()):
            found.add(tuple(sorted(total.items(), reverse=True)))

    for a in sizes.tolist():
        most = min(capacity // a, int(have[a]))
        for k in sorted({*range(most, max(0, most - REPEATS // 2), -1), *range(1, min(most, REPEATS // 2) + 1)}):
            rest = capacity - k * a
            if not rest:
                add((a, k))
                continue
            if have[rest]:
                add((a, k), (rest, 1))
            first = sizes[(sizes >= rest - rest // 2) & (sizes < rest)]
            both = np.minimum(have[first], have[rest - first])
            for i in np.argsort(-both, kind="stable")[:PARTNERS].tolist():
                if both[i]:
                    add((a, k), (int(first[i]), 1), (rest - int(first[i]), 1))
    lengths, repeats = np.zeros((len(found), 3), np.int64), np.zeros((len(found), 3), np.int64)
    for row, parts in enumerate(sorted(found)):
        for at, (size, n) in enumerate(parts):
            lengths[row, at], repeats[row, at] = size, n
    return lengths, repeats


def least_squares(lengths: np.ndarray, repeats: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x of least |A x - histogram|, by accelerated projected gradients.

    Column c of A has `repeats[c]` at `lengths[c]`.
    """
    if not len(lengths):
        return np.zeros(0)
    flat, weight = lengths.ravel(), repeats.astype(np.float64)

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (weight * x[:, None]).ravel(), len(histogram))

    def transposed(y: np.ndarray) -> np.ndarray:
        return (weight * y[lengths]).sum(axis=1)

    v = np.ones(len(lengths))
    for _ in range(POWER_STEPS):
        w = transposed(product(v))
        norm = np.linalg.norm(w)
        v = w / norm
    rate, x = 0.9 / norm, np.zeros(len(lengths))
    y, t = x, 1.0
    for _ in range(steps):
        after = np.maximum(0, y - rate * transposed(product(y) - histogram))
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        # Momentum that leads uphill starts anew.
        if ((after - x) * (y - after)).sum() > 0:
            faster = 1.0
            y = after
        else:
            y = after + (t - 1) / faster * (after - x)
        x, t = after, faster
    return x


Pattern = tuple[int, tuple[tuple[int, int], ...]]


def patterns(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns (times, ((length, repeats), ...)) that fill a window exactly, and the
    lengths that remain."""
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = np.array(sorted(left), np.int64)
    lengths, repeats = combinations(sizes, np.array([left[s] for s in sizes.tolist()], np.int64), capacity)
    wanted = np.zeros(capacity + 1)
    wanted[sizes] = [left[s] for s in sizes.tolist()]
    x = least_squares(lengths, repeats, wanted)
    out: list[Pattern] = []

    def use(pattern: tuple[tuple[int, int], ...], most: int | None) -> int:
        times = min(left.get(s, 0) // n for s, n in pattern)
        times = times if most is None else min(times, most)
        if times > 0:
            out.append((times, pattern))
            for s, n in pattern:
                left[s] -= times * n
        return times

    rows = [tuple((int(s), int(n)) for s, n in zip(a, b, strict=True) if n) for a, b in zip(lengths, repeats, strict=True)]
    order = np.argsort(-x, kind="stable").tolist()
    for i in order:
        if x[i] >= 1:
            use(rows[i], int(x[i]))
    for i in order:
        use(rows[i], None)
    # Longest first: each round uses a length up, or leaves it to be cut.
    cut: dict[int, int] = {}
    left = {s: n for s, n in left.items() if n}
    while left:
        open_, room, pattern, limit = sorted(left), capacity, [], capacity
        while room:
            at = bisect_right(open_, min(room, limit)) - 1
            if at < 0:
                break
            s = open_[at]
            n = min(left[s], room // s)
            pattern.append((s, n))
            room, limit = room - n * s, s - 1
        if room:
            s = open_[-1]
            cut[s] = left.pop(s)
        else:
            use(tuple(pattern), None)
            left = {s: n for s, n in left.items() if n}
    return out, cut


@dataclass(frozen=True)
class Plan:
    """Where the copies of every length go.

    Copies first..first+count-1 of a length lie, `repeat` to a window, from window
    `sequence` on at `offset`; copies from `planned` on lie behind one another from
    `base` on in the stream that is cut.  Stream windows follow from `sequences`
    on: `full` of them have the whole capacity, and `tail` has the ends of the others.
    """

    slots: np.ndarray  # length, first, repeat, sequence, offset; by length and first
    planned: np.ndarray
    base: np.ndarray
    sequences: int
    full: int
    tail: np.ndarray
    capacity: int

    def window(self, at: np.ndarray) -> np.ndarray:
        """The stream window of a position."""
        return np.where(at < self.full * self.capacity, at // self.capacity,
                        self.full + np.searchsorted(self.tail, at, side="right"))

    def begin(self, window: np.ndarray) -> np.ndarray:
        """The position at which a stream window begins."""
        ends = np.r_[self.full * self.capacity, self.tail]
        return np.where(window <= self.full, window * self.capacity, ends[np.clip(window - self.full, 0, len(ends) - 1)])

    def placed(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parts of pieces: the piece, begin and end within it, sequence and offset."""
        streamed = rank >= self.planned[size]
        piece, out = np.flatnonzero(~streamed), []
        if len(piece):
            lengths, firsts, repeats, sequences, offsets = self.slots.T
            span = int(firsts.max()) + 1
            at = np.searchsorted(lengths * span + firsts, size[piece] * span + np.minimum(rank[piece], span - 1), side="right") - 1
            i = rank[piece] - firsts[at]
            out.append((piece, np.zeros_like(piece), size[piece], sequences[at] + i // repeats[at],
                        offsets[at] + i % repeats[at] * size[piece]))
        piece = np.flatnonzero(streamed)
        if len(piece):
            from_ = self.base[size[piece]] + (rank[piece] - self.planned[size[piece]]) * size[piece]
            to = from_ + size[piece]
            first = self.window(from_)
            times = self.window(to - 1) - first + 1
            row = np.repeat(np.arange(len(piece)), times)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            begin = np.maximum(from_[row], self.begin(window))
            end = np.minimum(to[row], self.begin(window + 1))
            out.append((piece[row], begin - from_[row], end - from_[row], self.sequences + window, begin - self.begin(window)))
        return tuple(np.concatenate(x) for x in zip(*out))


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    made, cut = patterns(histogram, capacity)
    next_copy = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0
    for times, pattern in made:
        offset = 0
        for s, n in pattern:
            slots.append((s, next_copy[s], n, sequence, offset))
            next_copy[s] += times * n
            offset += n * s
        sequence += times
    base, at = np.zeros(capacity + 1, np.int64), 0
    for s in sorted(cut, reverse=True):
        base[s] = at
        at += s * cut[s]
    full, rest = divmod(at, capacity)
    tail, end = [], full * capacity
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            end += 1 << bit
            tail.append(end)
    return Plan(np.array(sorted(slots), np.int64).reshape(-1, 5), next_copy, base, sequence, full, np.array(tail, np.int64), capacity)


def _packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that have so many of the ids each, in order."""
    ends = np.r_[0, np.cumsum(sizes)] * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.tobytes())])


def _unpacked(values: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The ids of binary values, of 16 bits if they are that short, as 32 bits."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return raw.view("<u2" if len(raw) == 2 * sizes.sum() else "<u4").astype("<u4")


def pack(df: DataFrame, path: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """One row per piece: the other columns, then start, length, ids (packed
    little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    A null text is empty and still has its end id, so every row gives at least one
    piece; repeated rows get places of their own.  Columns named like the new ones
    are replaced.  No row at all gives no piece.
    """
    part, local, cuts, first = (free_name(df, f"window_{x}") for x in ("part", "rank", "cuts", "first"))
    keep = [c for c in others(df, NEW) if c != text]

    def start():
        word_ids = kept(f"word ids {path} {end_id}", lambda: WordIds(path, end_id))
        kind = "<u2" if max(end_id + 1, word_ids.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def run(texts):
            rows = word_ids.ids([t or "" for t in texts.to_pylist()])
            sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            n = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(rows)), n)
            at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(sizes[owner] - at, capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            counts = np.diff(np.r_[starts, len(ordered)])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(starts, counts) + seen[ordered]
            seen[ordered[starts]] += counts
            ids = _packed(np.frombuffer(b"".join(rows), "<u4").astype(kind), length)
            entries = pa.StructArray.from_arrays(
                [pa.array(at), pa.array(length), ids, pa.array(rank)], ["start", "length", "ids", local])
            return [pa.array(sizes), pa.array(np.full(len(rows), task, np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), entries)]
        return run

    entry = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                          T.StructField("ids", T.BinaryType()), T.StructField(local, T.LongType())])
    made = map_columns(df.select(*map(col, keep), col(text)), [text], T.StructType([
        T.StructField("doc_tokens", T.LongType()), T.StructField(part, T.LongType()), T.StructField(cuts, T.ArrayType(entry))]),
        start, keeps=True)
    rows = written(made.select(*map(col, keep), "doc_tokens", part, F.inline(cuts)), "windows")
    counts = written(rows.groupBy("length", F.col(part).alias("part")).agg(F.count("*").alias("n")), "window-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = df.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    # Copies per task and length, so a window over a length has one row per task.
    before = counts.withColumn(first, F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.join(
        before.select(F.col("length").alias("of length"), F.col("part").alias("of part"), first),
        (F.col("length") == F.col("of length")) & (F.col(part) == F.col("of part")))
    sent = ranked.select(*map(col, keep), "doc_tokens", "start", "length", "ids", (F.col(first) + F.col(local)).alias(first))
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    n_keep = len(keep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            for rows in slices(batch):
                tokens, start_, length, ids, rank = (rows.column(n_keep + k) for k in range(5))
                size = length.to_numpy()
                piece, begin, end, sequence, offset = where.placed(size, rank.to_numpy())
                order = np.argsort(piece, kind="stable")
                piece, begin, end, sequence, offset = (x[order] for x in (piece, begin, end, sequence, offset))
                every = _unpacked(ids, size)
                n = end - begin
                from_ = (np.cumsum(size) - size)[piece] + begin
                taken = every[np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                at = pa.array(piece)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(k).take(at) for k in range(n_keep)]
                    + [pa.array(start_.to_numpy()[piece] + begin), pa.array(n), _packed(taken, n),
                       tokens.take(at), pa.array(sequence), pa.array(offset)], schema.fieldNames())

    return sent.mapInArrow(place, schema)

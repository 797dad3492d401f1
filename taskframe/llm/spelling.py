"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if they
are different, their lengths differ by at most one, and their common prefix and
common suffix together reach the longer length minus one.  Words lie as rows of
padded code-point matrices, aligned left for prefixes and right for suffixes;
blocks of rows are compared with blocks of rows, every pair of them at once.

Only blocks that can hold near words meet.  For a longer length L the edit lies
in one of the windows of two places that cut L; outside that window both words
are equal.  So a word enters, for L its own length and one more, one block per
window, by what lies outside of it.  Words of one block differ within two places
only, which bounds a block by the square of the alphabet at any size of the
data.  A pair counts in the window where its common prefix ends, so once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm.frames import col, slices, written

# Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
WINDOW = 2
# Words of a tile, cells of a comparison held at once, and words a task counts
# before it hands them on.
TILE, CELLS, HELD_WORDS = 256, 1 << 22, 300_000


def _slipped(run: bytes, h: int) -> bytes:
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def word_counts(df: DataFrame, id: str, text: str = "text", modulus: int = 199) -> DataFrame:
    """Words of all texts and how often they occur: word, n.

    Words are the runs of Latin letters, A-Z lower-cased.  A run whose checksum
    with the row's id, crc32 of `<id>:<run>`, is divisible by `modulus` has lost
    one code point, the one at the checksum modulo its length; what is left of a
    run of one is the empty word.  A null id is written as nothing.  Null texts
    have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = Counter(_RUN.findall((t or "").encode().lower()))
                    start = crc(f"{'' if i is None else i}:".encode())
                    for run in [r for r in found if crc(r, start) % modulus == 0]:
                        n = found.pop(run)
                        held[_slipped(run, crc(run, start))] += n
                    held.update(found)
                if len(held) > HELD_WORDS:
                    yield made()
        if held:
            yield made()

    sent = df.select(col(id), col(text))
    return sent.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(word: Column) -> Column:
    """The blocks of a word: a hash of longer length, window and what lies outside."""
    length = F.length(word)

    def of(longer: Column) -> Column:
        def block(at: Column) -> Column:
            after = F.greatest(longer - at - WINDOW, F.lit(0))
            return F.struct(
                F.xxhash64(longer, at, F.substring(word, F.lit(1), at),
                           F.substring(word, length - after + 1, after)).alias("block"),
                longer.alias("longer"), at.alias("at"))

        return F.transform(F.sequence(F.lit(0), longer - 1, F.lit(WINDOW)), block)

    return F.concat(of(length), of(length + 1))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right, padded with zeros, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(sizes.max(initial=1))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    rows = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.zeros((len(words), wide), np.uint32)
    right = np.zeros((len(words), wide), np.uint32)
    left[rows, at] = points
    right[rows, np.repeat(sizes, sizes) - 1 - at] = points
    return left, right, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading places are equal, along the last axis."""
    same = a == b
    return np.where(same.all(axis=-1), same.shape[-1], same.argmin(axis=-1))


def near_tiles(words: list[str], block: np.ndarray, longer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words.

    Blocks of one size are stacked and compared with themselves at once; larger
    ones are cut into tiles, and tiles are compared in pairs.  Rows of one longer
    length lie together, so that a few long words widen no other matrix.
    """
    order = np.lexsort((block, longer))
    block, longer, at = block[order], longer[order], at[order]
    starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (longer[1:] != longer[:-1])])
    ends = np.r_[starts[1:], len(block)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(starts):
        wide, hi = int(longer[starts[lo]]), lo + 1
        while hi < len(starts) and longer[starts[hi]] == wide and (ends[hi] - starts[lo]) * wide <= CELLS:
            hi += 1
        first, last = starts[lo], ends[hi - 1]
        own = [words[k] for k in order[first:last].tolist()]
        x, y = _near_of_length(own, wide, at[first:last], starts[lo:hi] - first, (ends - starts)[lo:hi])
        found.append((order[first + x], order[first + y]))
        lo = hi
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _near_of_length(words: list[str], longer: int, at: np.ndarray, starts: np.ndarray,
                    members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words whose longer length is `longer`, in blocks that begin at `starts`."""
    left, right, sizes = _matrices(words)
    found = [(at[:0].astype(np.int64),) * 2]

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        """Row numbers (tiles, rows) against (tiles, rows)."""
        x, y = x[:, :, None], y[:, None, :]
        long, short = np.maximum(sizes[x], sizes[y]), np.minimum(sizes[x], sizes[y])
        prefix = np.minimum(_common(left[x], left[y]), short)
        suffix = np.minimum(_common(right[x], right[y]), short)
        place = np.minimum(prefix, long - 1) - at[x]
        near = ((x < y) & (long == longer) & (long - short <= 1) & (prefix + suffix >= long - 1) & (at[x] == at[y])
                & (place >= 0) & (place < WINDOW) & ((prefix < short) | (long > short)))
        t, i, j = np.nonzero(near)
        found.append((x[t, i, 0], y[t, 0, j]))

    tile = max(1, min(TILE, int((CELLS // longer) ** 0.5)))
    for g in np.unique(members[members > 1]).tolist():
        of_size = starts[members == g]
        if g <= tile:
            step = max(1, CELLS // (g * g * longer))
            for k in range(0, len(of_size), step):
                rows = of_size[k:k + step, None] + np.arange(g)
                compare(rows, rows)
            continue
        for s in of_size.tolist():
            tiles = [np.arange(i, min(i + tile, s + g))[None, :] for i in range(s, s + g, tile)]
            for i, x in enumerate(tiles):
                for y in tiles[i:]:
                    compare(x, y)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame) -> DataFrame:
    """Every pair of near words, both ways: word, near, near_n.

    `words` has distinct non-empty words and their n; null words are left out.
    """
    spread = words.where(F.length("word") > 0).select("word", "n", F.explode(_blocks(F.col("word"))).alias("b"))
    ordered = spread.select("b.*", "word", "n").repartition("block").sortWithinPartitions("block", "longer", "at", "word")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def made(rows: pa.Table) -> pa.RecordBatch:
            block, longer, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("block", "longer", "at"))
            n = rows.column("n").to_numpy()
            # Alone in its block a word has nothing to be compared with.
            same = block[1:] == block[:-1]
            some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            words = rows.column("word").take(pa.array(some)).to_pylist()
            n = n[some]
            i, j = near_tiles(words, block[some], longer[some], at[some]) if words else (some[:0], some[:0])
            a, b = np.r_[i, j].tolist(), np.r_[j, i]
            return pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in a], pa.string()), pa.array([words[k] for k in b.tolist()], pa.string()),
                 pa.array(n[b] if len(b) else [], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            block = rows.column("block").to_numpy()
            # The last block may go on in the next batch.
            tail = int(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[-1]) if len(block) else 0
            if tail:
                yield made(rows.slice(0, tail).combine_chunks())
            rest = rows.slice(tail).combine_chunks()
        if rest is not None and rest.num_rows:
            yield made(rest)

    return ordered.mapInArrow(tiled, T.StructType([
        T.StructField("word", T.StringType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())]))


def roots(forms: DataFrame) -> DataFrame:
    """Of each word with a form, the last one reached over forms: word, root.

    `forms` has word and form, and no cycles.  Every round doubles the way, so the
    rounds are the logarithm of the longest chain; each is written.
    """
    ways = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = written(ways.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            return ways


def variants(counts: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """Words with their forms: word, form, root (string), n, n_near, form_n (long).

    `counts` has word and n, one row per word.  Words of at least `least_length`
    code points and `least_count` occurrences are compared.  A word's form is its
    near word of largest n, the first in code-point order among equals, if that is
    at least `ratio` times its own n; ratio is 2 at least, so forms have no cycle.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    words = written(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)).select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.order") >= ratio * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("best.order")).alias("form_n")), "variants")
    rooted = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

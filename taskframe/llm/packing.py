"""Best-fit packing of tokenised documents after a dominance reduction.

Documents longer than a sequence are cut into pieces of its capacity.  What is
left to decide depends on the histogram of piece lengths alone, which has at
most `capacity` entries at any data size: it is the only thing the driver sees.

The reduction follows Martello and Toth.  For the longest open length it looks
for a set of at most two partners that dominates every other set the piece could
share a sequence with, and fixes that set for as many pieces as it holds for:
no partner fits; one fills the sequence exactly; no two fit together, so the
longest that fits is best; at most two fit, and the longest that fits with the
longest remaining beside it dominate each pair.  What remains is packed by
best fit in order of decreasing length.

Both steps work on counts: a pattern and how many sequences have it.  Pieces get
their place by their rank among those of the same length, which comes from
counts per task.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from taskframe.llm.byte_bpe import byte_letters
from taskframe.llm.frames import col, free_name, kept, map_columns, written

# Distinct words, and distinct lower-case cores of words, that a worker keeps
# ids of before it starts anew; longer ones are not kept.
CACHE_WORDS, CACHE_CORES, CACHE_LENGTH = 700_000, 450_000, 64
# Marks that form a pre-token of their own after a letter or digit.
_TRAILING = ".,;:!?%&$#*"


def _core(word: str) -> tuple[str, str]:
    """A word as the lower-case part that is looked up, and the marks after it.

    The library composes characters, then lower-cases them, then splits.  Marks
    after a letter or digit start a token of their own.  Lower-casing first is
    the same where both forms are composed already.
    """
    core = word.rstrip(_TRAILING)
    if word.isascii():
        if core and core[-1].isalnum():
            return core.lower(), word[len(core):]
        return word.lower(), ""
    lower = "".join(map(str.lower, core))
    if not lower or not lower[-1].isalnum():
        core, lower = word, "".join(map(str.lower, word))
    if not (unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", lower)):
        return word, ""
    return lower, word[len(core):]


class WordIds:
    """Ids of whole texts by the tokenizers library, looked up word by word.

    For vocabularies that compose, lower-case and drop white space, and let no
    token cross it, the ids of a text are those of its words in order.  Only new
    cores of words reach the library.  Texts that hold a special string go to it
    whole, and words that hold one in another case as they stand.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower_specials = [s.decode().lower() for s in self.specials]
        self.end = np.array([end_id], "<u4").tobytes()
        # A line end parts words and is in none.
        self.letters = {b: c for c, b in byte_letters().items() if b != 10}
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _cut(self, words: list[bytes]) -> tuple[list[str], dict[int, str]]:
        """The part of each word that is looked up, and the marks after it where there are some.

        All words go through it as one text.  Those that only a look at each word
        decides are cut one by one: other forms of composed characters, a letter
        whose lower case depends on its place, special strings in another case.
        """
        whole = b"\n".join(words).decode()
        lower = whole.lower()
        heads, marks = lower.split("\n"), {}
        for i in [i for i, w in enumerate(heads) if w[-1] in _TRAILING]:
            core = heads[i].rstrip(_TRAILING)
            if core and core[-1].isalnum():
                heads[i], marks[i] = core, heads[i][len(core):]
        if not whole.isascii() and ("\u03a3" in whole or not (
                unicodedata.is_normalized("NFC", whole) and unicodedata.is_normalized("NFC", lower))):
            for i, w in enumerate(words):
                if not w.isascii():
                    heads[i], marks[i] = _core(w.decode())
        # The library looks for special strings before it lower-cases, so words that
        # hold one in another case stay as they are.
        if any(s in lower for s in self.lower_specials):
            for i, w in enumerate(words):
                if any(s in w.decode().lower() for s in self.lower_specials):
                    heads[i], marks[i] = w.decode(), ""
        return heads, marks

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        heads, marks = self._cut(words)
        cores = self.cores
        new = list({*heads, *marks.values()}.difference(cores))
        # A lower-case composed word of Latin letters is one pre-token as it is.
        plain = [w for w in new if w.isalpha() and (w.isascii() or max(w) < "\u0250")]
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        as_letters = "\n".join(plain).encode().decode("latin-1").translate(letters).split("\n")
        for w, x in zip(plain, as_letters, strict=True) if plain else ():
            cores[w] = array("I", [t.id for t in tokenize(x)]).tobytes()
        rest = [w for w in new if w not in cores]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        cores.update(zip(rest, (array("I", e.ids).tobytes() for e in found), strict=True))
        known = self.known
        known.update(zip(words, map(cores.__getitem__, heads), strict=True))
        for i, tail in marks.items():
            known[words[i]] += cores[tail]
        for part in new:
            if len(part) > CACHE_LENGTH:
                del cores[part]

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.cores) > CACHE_CORES:
            self.cores.clear()
        known, rows, open_rows, missing = self.known, [], [], set()
        for text in texts:
            raw = text.encode()
            if any(s in raw for s in self.specials):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                rows.append(np.array(ids, "<u4").tobytes())
                continue
            words = raw.split()
            found = list(map(known.get, words))
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                new = [words[i] for i in at]
                missing.update(new)
                open_rows.append((len(rows), at, new))
                rows.append(found)
            else:
                rows.append(b"".join(found))
        fresh = list(missing)
        self._learn(fresh)
        for row, at, new in open_rows:
            found = rows[row]
            for i, w in zip(at, new, strict=True):
                found[i] = known[w]
            rows[row] = b"".join(found)
        for w in fresh:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return [r + self.end for r in rows]


def pieces(df: DataFrame, path: str, capacity: int, end_id: int = 1, text: str = "text") -> DataFrame:
    """One row per piece: the other columns, then piece, start, length, ids.

    `ids` is packed little-endian unsigned 32-bit.  A null text is empty and
    still has its end id, so every row gives at least one piece.  Columns named
    like the new ones are replaced.
    """

    def start():
        word_ids = kept(f"word ids {path} {end_id}", lambda: WordIds(path, end_id))
        step = 4 * capacity

        def run(texts):
            rows = word_ids.ids([t or "" for t in texts.to_pylist()])
            return [pa.array([[r[i:i + step] for i in range(0, len(r), step)] for r in rows],
                             pa.list_(pa.binary()))]
        return run

    cut = map_columns(df, [text], T.StructType([T.StructField("ids", T.ArrayType(T.BinaryType()))]), start, keeps=True)
    new = {"piece", "start", "length", "ids"}
    rest = [c for c in cut.columns if c.lower() not in new and c != text]
    rows = cut.select(*map(col, rest), F.posexplode("ids").alias("piece", "ids"))
    return rows.select(
        *map(col, rest), "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


@dataclass(frozen=True)
class Slots:
    """Copies first..first+count-1 of a length lie at `offset` of sequences from `sequence` on."""

    length: int
    first: int
    sequence: int
    offset: int
    count: int


class _Open:
    """Lengths still open, with counts."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest pieces beside one of length `without`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.count[s] - (s == without))
            if len(out) == k:
                break
        return out

    def largest(self, limit: int, *without: int) -> int | None:
        """The longest piece of at most `limit` beside the given ones."""
        at = bisect_right(self.sizes, limit) - 1
        while at >= 0:
            s = self.sizes[at]
            if self.count[s] > without.count(s):
                return s
            at -= 1
        return None


def _dominating(w: int, free: int, left: _Open) -> tuple[int, ...] | None:
    """Partners of a piece of length w that dominate all others, if known."""
    best = left.largest(free, w)
    if best is None:
        return ()
    if best == free:
        return (best,)
    least = left.smallest(3, w)
    if len(least) < 2 or least[0] + least[1] > free:
        return (best,)
    if len(least) < 3 or sum(least) > free:
        second = left.largest(free - best, w, best)
        half = left.largest(free // 2, w)
        # Any pair x >= y has x <= best and y <= half.
        if second is not None and half is not None and second >= half:
            return (best, second)
    return None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed patterns with their counts, and the histogram that remains."""
    left, fixed, found = _Open(histogram), [], True
    while found:
        found = False
        for w in reversed(left.sizes.copy()):
            while w in left.count:
                partners = _dominating(w, capacity - w, left)
                if partners is None:
                    break
                pattern = (w, *partners)
                times = min(left.count[s] // pattern.count(s) for s in set(pattern))
                for s in set(pattern):
                    left.take(s, times * pattern.count(s))
                fixed.append((times, pattern))
                found = True
    return fixed, left.count


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing: patterns with their counts."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    room: list[int] = []

    def put(free: int, count: int, pattern: tuple[int, ...]) -> None:
        if not count:
            return
        if free not in bins:
            bins[free] = []
            insort(room, free)
        bins[free].append((count, pattern))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            at = bisect_left(room, s)
            if at < len(room):
                free = room[at]
                count, pattern = bins[free].pop()
                if not bins[free]:
                    del bins[free], room[at]
            else:
                free, count, pattern = capacity, n, ()
            each = free // s
            full = min(count, n // each)
            put(free - each * s, full, pattern + (s,) * each)
            n -= full * each
            if full < count:
                if n and n < each:
                    put(free - n * s, 1, pattern + (s,) * n)
                    full, n = full + 1, 0
                if pattern:
                    put(free, count - full, pattern)
    return [x for free in room for x in bins[free]]


def plan(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Where the copies of every length go."""
    fixed, rest = reduce_instance(histogram, capacity)
    next_copy: dict[int, int] = dict.fromkeys(histogram, 0)
    out, sequence = [], 0
    for count, pattern in fixed + best_fit(rest, capacity):
        offset = 0
        for s in pattern:
            out.append(Slots(s, next_copy[s], sequence, offset, count))
            next_copy[s] += count
            offset += s
        sequence += count
    return sorted(out, key=lambda x: (x.length, x.first))


def pack(df: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """The rows with the sequence_id and offset of each piece.

    `length` is 1 to `capacity` in every row.  Equal lengths are interchangeable;
    repeated rows get places of their own.  Columns with the new names are replaced.
    """
    # Written first, so that numbering needs no second Python worker beside the
    # one that makes the pieces.
    df = written(df, "pieces")
    part, local = free_name(df, "packing_part"), free_name(df, "packing_rank")

    def number():
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()

        def run(lengths):
            sizes = lengths.to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            counts = np.diff(np.r_[starts, len(ordered)])
            ranks = np.empty(len(sizes), np.int64)
            ranks[order] = np.arange(len(sizes)) - np.repeat(starts, counts) + seen[ordered]
            seen[ordered[starts]] += counts
            return [pa.array(np.full(len(sizes), task, np.int64)), pa.array(ranks)]
        return run

    rows = written(map_columns(df, [length], T.StructType([
        T.StructField(part, T.LongType()), T.StructField(local, T.LongType())]), number), "packing")
    counts = rows.groupBy(col(length).alias("length"), F.col(part).alias("part")).agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    arrays = [np.array([getattr(s, f) for s in slots], np.int64)
              for f in ("length", "first", "sequence", "offset")]
    # Copies per task and length, so a window over a length has one row per task.
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    first = free_name(df, "packing_first")
    ranked = rows.join(
        before.select(F.col("length").alias("of length"), F.col("part").alias("of part"),
                      F.coalesce("before", F.lit(0)).alias(first)),
        (col(length) == F.col("of length")) & (F.col(part) == F.col("of part"))
    ).drop("of length", "of part")
    shared = df.sparkSession.sparkContext.broadcast(arrays)

    def place():
        sizes, firsts, sequences, offsets = shared.value
        bounds = np.searchsorted(sizes, np.arange(capacity + 2))
        # One ordered key per slot: its length, then its first copy.
        span = int(firsts.max(initial=0)) + 1
        keys = sizes * span + firsts

        def run(lengths, firsts_of_part, locals_):
            size = lengths.to_numpy(zero_copy_only=False)
            rank = firsts_of_part.to_numpy(zero_copy_only=False) + locals_.to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, size * span + np.minimum(rank, span - 1), side="right") - 1
            at = np.clip(at, bounds[size], bounds[size + 1] - 1)
            return [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])]
        return run

    placed = map_columns(ranked, [length, first, local], T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]), place)
    return placed.drop(part, local, first)

"""Alignment of two tokenizers over the same texts by pointer jumping.

Both tokenize space and text; byte offsets at which a token of either ends cut
the tokens into groups.  Every token points to its farthest-right overlapping
token: the other tokenizer's token that holds its last byte, if that one ends
further right.  Successors are doubled for all tokens at once until nothing
changes; then each token points to the last one of its group, which labels it.

Neither vocabulary has a token across a single space between two other
characters, other than at its start, so texts are cut there.  The cuts are
tokenized and aligned once for each distinct string that a worker meets.

An id pair's count is the number of documents that hold it linked.  Pairs more
frequent than one in `1 / HOT_SHARE` of all are looked up in the tasks, as there
are at most HOT_SHARE of them; the others go through a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm.byte_bpe import byte_letters
from taskframe.llm.frames import col, free_name, kept, map_columns, others, written

# An id pair as one number: the first id times this, and the second.
PAIR = 1 << 16
HOT_SHARE = 1 << 18
# Cuts a worker keeps before it starts anew, and the longest one kept.
CACHE_ENTRIES, CACHE_LENGTH = 250_000, 64
# Cuts tokenized and aligned at once.
TOGETHER = 8192
# Pair occurrences a counting task holds before it hands them on.
HELD_PAIRS = 4_000_000
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Tokenizers:
    """Ids of strings by both tokenizers, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) if i in range(size)
                        and all(c in letters for c in self.a.id_to_token(i)) else b"" for i in range(size)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.lengths_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.lengths_b = np.array(list(map(len, self.bytes_b)), np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def of(self, cuts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both id lists of each cut, which starts with the space that B adds."""
        found = self.a.encode_batch_fast(cuts, add_special_tokens=False)
        return [e.ids for e in found], self.b.encode([c[1:] for c in cuts], num_threads=1)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and how many each row has."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), sizes


def _spans(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last A token of the group of every token, A's first and then B's.

    `ends` are the byte offsets at which the tokens of two gapless sequences over
    the same bytes end.
    """
    n = len(ends_a)
    # The other's token that holds a token's last byte is the first to end there or later.
    over_a = np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    at_a = np.arange(n)
    # Where both end together the A token is the last one and points to itself.
    ahead = np.r_[np.where(ends_b[over_a] > ends_a, over_a + n, at_a) if n else at_a, over_b]
    while True:
        further = ahead[ahead]
        if np.array_equal(further, ahead):
            return ahead
        ahead = further


class Aligned:
    """What every cut gives: counts, the groups' string, and linked id pairs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.tokenizers = Tokenizers(path_a, path_b)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, cuts: list[str]) -> None:
        for k in range(0, len(cuts), TOGETHER):
            self._learn(cuts[k:k + TOGETHER])

    def _learn(self, cuts: list[str]) -> None:
        """Tokenize and align new cuts, all in one."""
        t = self.tokenizers
        rows_a, rows_b = t.of(cuts)
        raw = [c.encode() for c in cuts]
        # A cut whose tokens do not give its bytes has no alignment.
        same = np.array([b"".join(map(t.bytes_a.__getitem__, a)) == r == b"".join(map(t.bytes_b.__getitem__, b))
                         for a, b, r in zip(rows_a, rows_b, raw, strict=True)], bool)
        rows_a = [x if ok else [] for x, ok in zip(rows_a, same, strict=True)]
        rows_b = [x if ok else [] for x, ok in zip(rows_b, same, strict=True)]
        ids_a, sizes_a = _flat(rows_a)
        ids_b, sizes_b = _flat(rows_b)
        # Cuts lie behind one another, and each ends where both end: one run for all.
        label = terminals(np.cumsum(t.lengths_a[ids_a]), np.cumsum(t.lengths_b[ids_b]))
        last = np.flatnonzero(label[:len(ids_a)] == np.arange(len(ids_a)))
        group = np.searchsorted(last, label)
        of_a, of_b = group[:len(ids_a)], group[len(ids_a):]
        owner = np.repeat(np.arange(len(cuts)), sizes_a)[last]
        in_a, in_b = np.bincount(of_a, minlength=len(last)), np.bincount(of_b, minlength=len(last))
        n_groups = np.bincount(owner, minlength=len(cuts))
        n_links = np.zeros(len(cuts), np.int64)
        np.add.at(n_links, owner, in_a * in_b)
        strings = self._strings(ids_a, in_a, ids_b, in_b)
        at = np.r_[0, np.cumsum(n_groups)].tolist()
        first = len(self.groups)
        self.groups += [";".join(strings[x:y]) for x, y in zip(at, at[1:])]
        # Equal ids of a group count together, so a long group of few ids has few pairs.
        who, pairs, links = self._pairs(ids_a, of_a, ids_b, of_b, owner)
        self.counts = np.vstack([self.counts, np.column_stack([sizes_a, sizes_b, n_groups, n_links])])
        self.counts[first:][~same] = -1
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.bincount(who, minlength=len(cuts)))]
        self.pairs, self.links = np.r_[self.pairs, pairs], np.r_[self.links, links]
        self.place.update(zip(cuts, range(first, first + len(cuts)), strict=True))

    @staticmethod
    def _strings(ids_a: np.ndarray, in_a: np.ndarray, ids_b: np.ndarray, in_b: np.ndarray) -> list[str]:
        sides = []
        for ids, sizes in ((ids_a, in_a), (ids_b, in_b)):
            texts, at = list(map(str, ids.tolist())), np.r_[0, np.cumsum(sizes)].tolist()
            sides.append([",".join(texts[x:y]) for x, y in zip(at, at[1:])])
        return [f"{a}|{b}" for a, b in zip(*sides)]

    @staticmethod
    def _pairs(ids_a, of_a, ids_b, of_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each cut with their links, by cut and pair."""
        sides = []
        for ids, group in ((ids_a, of_a), (ids_b, of_b)):
            keys, n = np.unique(group * PAIR + ids, return_counts=True)
            sides.append((keys // PAIR, keys % PAIR, n))
        (group_a, a, n_a), (group_b, b, n_b) = sides
        per_b = np.bincount(group_b, minlength=len(owner))
        first_b = np.cumsum(per_b) - per_b
        times = per_b[group_a]
        x = np.repeat(np.arange(len(a)), times)
        y = np.repeat(first_b[group_a], times) + _spans(times)
        key = owner[group_a[x]] * (PAIR * PAIR) + a[x] * PAIR + b[y]
        keys, where = np.unique(key, return_inverse=True)
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, where, n_a[x] * n_b[y])
        return keys // (PAIR * PAIR), keys % (PAIR * PAIR), links

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: counts, the digest of its groups, its pairs (ordered) and their links."""
        if len(self.place) > CACHE_ENTRIES:
            self.forget()
        rows = [_BETWEEN.split(" " + t) if t else [] for t in texts]
        # The split drops the space, which belongs to what follows.
        rows = [r[:1] + [" " + c for c in r[1:]] for r in rows]
        fresh = {c for r in rows for c in r}.difference(self.place)
        short = [c for c in fresh if len(c) <= CACHE_LENGTH]
        self.learn(short)
        kept_size, kept_pairs = len(self.groups), len(self.pairs)
        long = [c for c in fresh if len(c) > CACHE_LENGTH]
        self.learn(long)
        at, sizes = _flat([list(map(self.place.__getitem__, r)) for r in rows])
        owner = np.repeat(np.arange(len(texts)), sizes)
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, owner, self.counts[at])
        odd = np.zeros(len(texts), bool)
        odd[owner[self.counts[at, 0] < 0]] = True
        counts[odd] = 0
        groups = self.groups
        bounds = np.r_[0, np.cumsum(sizes)].tolist()
        places = at.tolist()
        digests = ["" if bad or lo == hi else hashlib.sha256(
            ";".join([groups[i] for i in places[lo:hi]]).encode()).hexdigest()
            for bad, lo, hi in zip(odd.tolist(), bounds, bounds[1:])]
        good = ~odd[owner]
        at, owner = at[good], owner[good]
        n = self.starts[at + 1] - self.starts[at]
        from_ = np.repeat(self.starts[at], n) + _spans(n)
        keys, where = np.unique(np.repeat(owner, n) * (PAIR * PAIR) + self.pairs[from_], return_inverse=True)
        links = np.bincount(where, self.links[from_], len(keys)).astype(np.int64)
        cut = np.searchsorted(keys, np.arange(len(texts) + 1) * (PAIR * PAIR))
        keys %= PAIR * PAIR
        pairs = [keys[x:y] for x, y in zip(cut, cut[1:])]
        of_pairs = [links[x:y] for x, y in zip(cut, cut[1:])]
        # Long cuts are not kept; they came last.
        for c in long:
            del self.place[c]
        del self.groups[kept_size:]
        self.counts, self.starts = self.counts[:kept_size], self.starts[:kept_size + 1]
        self.pairs, self.links = self.pairs[:kept_pairs], self.links[:kept_pairs]
        return counts, digests, pairs, of_pairs


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The frame with n_a, n_b, n_groups, n_links (long) and groups_sha256 of each text,
    and its distinct linked id pairs: `pairs` (packed unsigned 32-bit, ordered) and
    `links` (packed 64-bit), how many occurrences each has.

    A null or empty text, and one whose tokens do not spell it, has zeros, an empty
    digest and no pairs.  Columns of these names are replaced.
    """

    def start():
        aligned = kept(f"aligned {path_a} {path_b}", lambda: Aligned(path_a, path_b))

        def run(texts):
            counts, digests, pairs, links = aligned.of([t or "" for t in texts.to_pylist()])
            return [*(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()),
                    pa.array([p.astype("<u4").tobytes() for p in pairs], pa.binary()),
                    pa.array([n.astype("<i8").tobytes() for n in links], pa.binary())]
        return run

    return map_columns(df, [text], T.StructType(
        [T.StructField(n, T.LongType()) for n in NAMES[:4]]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()),
           T.StructField("links", T.BinaryType())]), start, keeps=True)


def pair_counts(rows: DataFrame, pairs: str = "pairs") -> DataFrame:
    """In how many rows each id pair occurs: pair, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    held.append(np.frombuffer(x, "<u4"))
                    size += len(held[-1])
                    if size > HELD_PAIRS:
                        yield made()
                        size = 0
        if held:
            yield made()

    return rows.select(col(pairs)).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The frame with the columns of `NAMES` for each text.

    n_best counts the links whose pair's count is the highest of its A id, ties
    included; count_sum is the sum of the pairs' counts over all links.  Texts
    without tokens have zeros.  Columns of these names are replaced.
    """
    keep, spark = others(df, NAMES), df.sparkSession
    pairs, links, row, best, total, rare = (
        free_name(df, f"align_{x}") for x in ("pairs", "links", "row", "best", "total", "rare"))
    made = align(df.select(*map(col, keep)), path_a, path_b, text)
    rows = written(made.select(
        *map(col, keep), *NAMES[:4], "groups_sha256", F.col("pairs").alias(pairs), F.col("links").alias(links),
        F.monotonically_increasing_id().alias(row)), "aligned")
    counts = written(pair_counts(rows, pairs), "pair-counts")
    # One row per A id of the vocabulary.
    highest = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))
    judged = written(counts.join(highest, F.shiftright("pair", 16) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("is_best")), "pair-judged")
    all_pairs = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_SHARE >= all_pairs
    found = judged.where(hot).toArrow()
    keys = found.column("pair").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((
        keys[order], found.column("n").to_numpy()[order],
        found.column("is_best").to_numpy(zero_copy_only=False)[order]))

    def start():
        keys, n, is_best = shared.value

        def run(pairs, links):
            pairs, links = pairs.to_pylist(), links.to_pylist()
            pair = np.frombuffer(b"".join(pairs), "<u4").astype(np.int64)
            times = np.frombuffer(b"".join(links), "<i8")
            owner = np.repeat(np.arange(len(pairs)), [len(p) // 4 for p in pairs])
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = []
            for value in (is_best, n):
                each = np.where(known, value[at] * times, 0) if len(keys) else np.zeros(len(pair), np.int64)
                out = np.zeros(len(pairs), np.int64)
                np.add.at(out, owner, each)
                sums.append(pa.array(out))
            missing = ~known
            sizes = np.bincount(owner[missing], minlength=len(pairs))
            entries = pa.StructArray.from_arrays([pa.array(pair[missing]), pa.array(times[missing])], ["pair", "n"])
            return [*sums, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), entries)]
        return run

    entry = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    looked = written(map_columns(rows, [pairs, links], T.StructType([
        T.StructField(best, T.LongType()), T.StructField(total, T.LongType()),
        T.StructField(rare, T.ArrayType(entry))]), start).drop(pairs, links), "looked-up")
    each = looked.select(F.col(row).alias("row"), F.explode(rare).alias("x")).select("row", "x.pair", "x.n")
    of_rare = judged.where(~hot).select("pair", F.col("n").alias("c"), "is_best")
    sums = each.join(of_rare, "pair").groupBy(F.col("row").alias("of row")).agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("rare_best"),
        F.sum(F.col("n") * F.col("c")).alias("rare_total"))
    joined = looked.join(sums, F.col(row) == F.col("of row"), "left")
    return joined.select(
        *map(col, keep), *NAMES[:4],
        (F.col(best) + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col(total) + F.coalesce("rare_total", F.lit(0))).alias("count_sum"), "groups_sha256")

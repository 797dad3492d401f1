"""BPE encoding and decoding by speculation.

A pre-token's proposal is the greedy longest match against the vocabulary.  A
sequence of tokens is the merge result exactly if every adjacent pair is: that
is, if merging the two tokens' joined bytes gives the two tokens again.  Numpy
checks all new distinct pairs of a batch at once by undoing merges at the
border, latest first, and looking for a merge across the border that would have
come earlier.  Pre-tokens with a failing pair are merged exactly.

Empty and null texts give no ids.  A special string inside a text becomes its
special id, as the file's library does by default.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskframe.llm.byte_bpe import CACHE_ENTRIES, CACHE_LENGTH, Pieces, Vocabulary, vocabulary
from taskframe.llm.frames import kept, map_columns


class PairCheck:
    """Whether joined token pairs merge back into themselves, for arrays of pairs."""

    def __init__(self, vocab: Vocabulary) -> None:
        size = len(vocab.bytes_of)
        self.size = size
        # Order in which a token comes to be: bytes first, then by rank.
        self.order = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        keys, orders = [], []
        for (a, b), rank in vocab.rank_of.items():
            made = vocab.made[rank]
            self.order[made], self.left[made], self.right[made] = rank, a, b
            keys.append(a * size + b)
            orders.append(rank)
        sort = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[sort]
        self.ranks = np.array(orders, np.int64)[sort]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or one beyond all ranks."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo, again and again, the later of the two merges beside the border.

        The merge across the border would have won over the undone one if its
        rank is lower, or equal when the undone one lies to its right.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # A crossing merge of a rank below the limit would have come first.
        limit = np.full(len(a), len(self.keys), np.int64)
        while len(live):
            crossing = self._rank(a, b) < limit
            ok[live[crossing]] = False
            go = ~crossing & ((self.order[a] >= 0) | (self.order[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            undo_left = self.order[a] > self.order[b]
            # To the left of the border an equal rank wins over the crossing
            # merge; to the right the crossing merge comes first.
            limit = np.where(undo_left, self.order[a], self.order[b] + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok


class Speculation:
    """Ids of pre-tokens: proposed, verified, and merged exactly where that fails."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.check = vocab, PairCheck(vocab)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.proposed = self.failed = 0

    def _greedy(self, word: bytes) -> list[int]:
        get, longest, at, n, out = self.vocab.id_of.get, self.vocab.longest, 0, len(word), []
        whole = get(word)
        if whole is not None:
            return [whole]
        while at < n:
            end = min(n, at + longest.get(word[at:at + 2], 1))
            while (found := get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        size, pairs = self.check.size, self.pairs
        raw = [w.encode() for w in words]
        guesses = [self._greedy(w) for w in raw]
        keys = [[x * size + y for x, y in zip(g, g[1:])] for g in guesses]
        new = list({k for ks in keys for k in ks}.difference(pairs))
        if new:
            made = np.array(new, np.int64)
            pairs.update(zip(new, self.check.compatible(made // size, made % size).tolist(), strict=True))
        self.proposed += len(words)
        for word, plain, guess, ks in zip(words, raw, guesses, keys, strict=True):
            # A word that is a token by itself has no pair; its own merges must give it.
            if (not ks and self._alone(guess)) or (ks and all(map(pairs.__getitem__, ks))):
                ids = guess
            else:
                self.failed += 1
                ids = self.vocab.merge(plain)
            self.words[word] = array("I", ids).tobytes()

    def _alone(self, guess: list[int]) -> bool:
        """Tokens come from merges, so the border inside a token decides as well."""
        if not guess:
            return True
        key = -1 - guess[0]
        if key not in self.pairs:
            token = self.vocab.bytes_of[guess[0]]
            self.pairs[key] = self.vocab.merge(token) == guess
        return self.pairs[key]

    def values(self, rows: list[list[str]]) -> list[bytes]:
        if len(self.words) > CACHE_ENTRIES or len(self.pairs) > CACHE_ENTRIES:
            self.words.clear()
            self.pairs.clear()
        words = self.words
        new = {w for row in rows for w in row}.difference(words)
        self.learn(list(new))
        out = [b"".join(map(words.__getitem__, row)) for row in rows]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del words[w]
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.speculation = Speculation(self.vocab)
        self.pieces = Pieces(self.vocab, self.speculation.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts, owner = [], []
        special = self.vocab.special_pattern
        for n, text in enumerate(texts):
            cut = special.split(text) if special and "<|" in text else [text]
            for k, part in enumerate(cut):
                parts.append(part)
                owner.append((n, k % 2 == 1))
        plain = iter(self.pieces.of([p for p, (_, s) in zip(parts, owner, strict=True) if not s]))
        out: list[list[bytes]] = [[] for _ in texts]
        for part, (n, is_special) in zip(parts, owner, strict=True):
            if is_special:
                out[n].append(np.array([self.vocab.specials[part]], "<u4").tobytes())
            else:
                out[n].extend(next(plain))
        return [b"".join(x) for x in out]


def encoder(path: str) -> Encoder:
    """The worker's encoder, with what it has learned."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def _decoded(vocab: Vocabulary, packed: list[bytes | None]) -> pa.Array:
    return pa.array([vocab.decode(np.frombuffer(p or b"", "<u4").tolist()) for p in packed], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The frame with the token ids of `text` as packed little-endian unsigned
    32-bit integers and, if `decoded` names a column, the text that these ids
    decode to.  Null text: no ids.  Columns with the new names are replaced."""
    fields = [T.StructField(ids, T.BinaryType())]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.StringType()))

    def start():
        codec = encoder(path)

        def run(texts):
            made = codec.encode([t or "" for t in texts.to_pylist()])
            out = [pa.array(made, pa.binary())]
            return out if decoded is None else [*out, _decoded(codec.vocab, made)]
        return run

    return map_columns(df, [text], T.StructType(fields), start, keeps=True)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The frame with the text of packed token ids, special strings included.
    Null ids: empty text.  Bytes that are no UTF-8 become U+FFFD."""

    def start():
        vocab = vocabulary(path)
        return lambda packed: [_decoded(vocab, packed.to_pylist())]

    return map_columns(df, [ids], T.StructType([T.StructField(text, T.StringType())]), start)

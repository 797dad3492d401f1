"""Byte-level BPE vocabularies: loading, pre-tokens, exact merging, decoding.

A text's pre-tokens depend on white space in one way only: a single space
between two other characters starts a new pre-token and belongs to it.  Texts
are therefore cut at such spaces, and the pieces, which repeat a lot, are
looked up.  Texts with any other run of white space next to a space go through
the pattern whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import regex

# The published split pattern of this family of vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Entries a worker keeps before it starts anew, and the longest text kept.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable
    Latin-1 letters stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Vocabulary:
    """Token bytes by id, merges by rank, and the special strings of a file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()
        self.id_of = {bytes(letters[c] for c in text): i for text, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.id_of.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left = bytes(letters[c] for c in left)
            right = bytes(letters[c] for c in right)
            self.rank_of[self.id_of[left], self.id_of[right]] = rank
            self.made.append(self.id_of[left + right])
        self.no_rank = len(self.made)
        # The longest token by its first two bytes bounds the search for a match.
        self.longest: dict[bytes, int] = {}
        for token in self.id_of:
            start = token[:2]
            self.longest[start] = max(self.longest.get(start, 1), len(token))
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")"
        ) if self.specials else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token by exact merging: lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank_of, none = self.rank_of.get, self.no_rank
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for very long pre-tokens."""
        n, get = len(ids), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (rank := get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Texts cut at single spaces, with one cached value per distinct piece.

    `values` turns lists of pre-tokens into one value each; a text's values in
    order make up the text's result.
    """

    def __init__(self, vocab: Vocabulary, values: Callable[[list[list[str]]], list]) -> None:
        self.findall, self.values = vocab.pattern.findall, values
        self.known: dict[str, object] = {}
        self.heads: dict[str, object] = {}
        self.uncut = {""}

    def _learn(self, known: dict[str, object], keys: list[str], prefix: str) -> None:
        found = self.values([self.findall(prefix + k) for k in keys])
        known.update(zip(keys, found, strict=True))

    def of(self, texts: list[str]) -> list[list]:
        if len(self.known) + len(self.heads) > CACHE_ENTRIES:
            self.known.clear()
            self.heads.clear()
            self.uncut = {""}
        rows, heads, parts = [], set(), set()
        for text in texts:
            head, *rest = text.split(" ")
            rows.append((head, rest))
            heads.add(head)
            parts.update(rest)
        heads.difference_update(self.heads)
        parts.difference_update(self.known)
        self._learn(self.heads, list(heads), "")
        self._learn(self.known, list(parts), " ")
        self.uncut.update(k for k in parts if k[-1:].isspace())
        known, out = self.known, []
        for text, (head, rest) in zip(texts, rows, strict=True):
            if rest and (head[-1:].isspace() or not self.uncut.isdisjoint(rest[:-1])):
                out.append(self.values([self.findall(text)]))
            else:
                out.append([self.heads[head], *map(known.__getitem__, rest)])
        for cache, new in ((self.heads, heads), (known, parts)):
            for k in new:
                if len(k) > CACHE_LENGTH:
                    del cache[k]
                    self.uncut.discard(k)
        return out

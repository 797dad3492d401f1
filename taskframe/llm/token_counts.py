"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is merged once by itself; those that come out
as one token are the proven ones.  A pre-token among them counts one without
any merging.  All others are merged exactly, once per worker and distinct form.

Empty and null texts count zero tokens.  A special string inside a text counts
one, as the file's library does by default.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm.byte_bpe import CACHE_ENTRIES, CACHE_LENGTH, Pieces, Vocabulary, vocabulary
from taskframe.llm.frames import col, kept, map_columns


@lru_cache(maxsize=4)
def proven_alone(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token.  Vocabulary
    entries that are no whole UTF-8 text cannot be pre-tokens."""
    vocab, found = vocabulary(path), []
    for token, i in vocab.id_of.items():
        if vocab.merge(token) == [i]:
            try:
                found.append(token.decode())
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counter:
    def __init__(self, path: str, alone: frozenset[str]) -> None:
        self.vocab: Vocabulary = vocabulary(path)
        self.alone = alone
        self.merged: dict[str, int] = {}
        self.pieces = Pieces(self.vocab, self.values)

    def values(self, rows: list[list[str]]) -> list[int]:
        if len(self.merged) > CACHE_ENTRIES:
            self.merged.clear()
        alone, merged, out = self.alone, self.merged, []
        for row in rows:
            total = 0
            for word in row:
                if word in alone:
                    total += 1
                    continue
                n = merged.get(word)
                if n is None:
                    n = len(self.vocab.merge(word.encode()))
                    if len(word) <= CACHE_LENGTH:
                        merged[word] = n
                total += n
            out.append(total)
        return out

    def count(self, texts: list[str]) -> list[int]:
        special, extra, parts, owner = self.vocab.special_pattern, [0] * len(texts), [], []
        for n, text in enumerate(texts):
            cut = special.split(text) if special and "<|" in text else [text]
            extra[n] = len(cut) // 2
            for part in cut[::2]:
                parts.append(part)
                owner.append(n)
        for n, values in zip(owner, self.pieces.of(parts), strict=True):
            extra[n] += sum(values)
        return extra


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """The frame with `n_bytes` (UTF-8), `n_tokens` and `over_limit`.

    Null text counts as empty.  Columns of these names are replaced; all other
    columns stay as they are.
    """
    alone = proven_alone(path)

    def start():
        counter = kept(f"counter {path}", lambda: Counter(path, alone))
        return lambda texts: [pa.array(np.array(
            counter.count([t or "" for t in texts.to_pylist()]), np.int64))]

    sized = df.withColumn("n_bytes", F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long"))
    counted = map_columns(sized, [text], T.StructType([T.StructField("n_tokens", T.LongType())]), start, keeps=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

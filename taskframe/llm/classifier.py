"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document's terms are its lower-cased words, the forms of its words (letters and
digits collapsed, all other characters kept), their lengths, and how much of it
repeats: the same word again, a line seen before, a word used before.  Forms and
words are hashed into `TERMS` buckets each; all terms are weighted by the root of their share times their inverse
document frequency over all documents.  A singular value decomposition of the
labelled sample gives the latent space.  The sample's vectors are broadcast;
every document's cosines with all of them are computed exactly, block by block,
and the labels of the nearest vote with their similarity.

The labelled sample is the only bounded part: at most `sample` rows, chosen by
a hash of their id.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm.frames import col, free_name, map_columns, others, written

TERMS, LENGTHS, EXTRA = 1024, 32, 4
WIDTH = 2 * TERMS + LENGTHS + EXTRA
# Votes fall by a factor e for each 1 / SHARPNESS of cosine.
SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 48, 25, 30
CACHE_ENTRIES = 400_000
_RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "9"),
         (re.compile(r"(.)\1+"), r"\1\1")]


def word_form(word: str) -> str:
    for runs, mark in _RUNS:
        word = runs.sub(mark, word)
    return word[:12]


class Terms:
    """Sparse term shares of texts, with the buckets of every word kept: its form's and its own."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> tuple[bytes, bytes]:
        words, known = text.split(), self.known
        if not words:
            return b"", b""
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (zlib.crc32(word_form(w).encode()) % TERMS, TERMS + zlib.crc32(w.lower().encode()) % TERMS)
        counts = np.zeros(WIDTH)
        n = len(words)
        places = np.array(list(map(known.__getitem__, words))).ravel()
        counts[:2 * TERMS] = np.bincount(places, minlength=2 * TERMS)
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, n), LENGTHS) - 1
        counts[2 * TERMS:2 * TERMS + LENGTHS] = np.bincount(lengths, minlength=LENGTHS) / 4
        lines = [line for line in text.split("\n") if line.strip()]
        counts[-4] = sum(map(operator.eq, words, words[1:]))
        counts[-3] = n * (len(lines) - len(set(lines))) / max(len(lines), 1)
        counts[-2] = n - len(set(words))
        counts[-1] = n / 4
        at = np.flatnonzero(counts)
        return at.astype("<u2").tobytes(), np.sqrt(counts[at] / n).astype("<f4").tobytes()


def terms(df: DataFrame, at: str, share: str, text: str = "text") -> DataFrame:
    """The frame with the sparse term shares of each text: buckets and weights."""

    def start():
        counter = Terms()

        def run(texts):
            rows = [counter.of(t or "") for t in texts.to_pylist()]
            return [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
        return run

    return map_columns(df, [text], T.StructType(
        [T.StructField(at, T.BinaryType()), T.StructField(share, T.BinaryType())]), start)


def _dense(ats: list[bytes], shares: list[bytes]) -> np.ndarray:
    out = np.zeros((len(ats), WIDTH), np.float32)
    sizes = [len(a) // 2 for a in ats]
    rows = np.repeat(np.arange(len(ats)), sizes)
    out[rows, np.frombuffer(b"".join(ats), "<u2")] = np.frombuffer(b"".join(shares), "<f4")
    return out


def document_frequencies(df: DataFrame, at: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows, over all rows."""

    def count(batches):
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total[np.frombuffer(part or b"", "<u2")] += 1
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(WIDTH), -1]), pa.array(np.r_[total, n])],
                                         ["term", "n"])

    rows = df.select(col(at)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}
    return np.array([found.get(i, 0) for i in range(WIDTH)], np.float64), found.get(-1, 0)


def labelled_sample(rows: DataFrame, labels: DataFrame, id: str, at: str, share: str, label: str, sample: int) -> list:
    """Terms and labels of at most `sample` labelled rows of the frame: h, i, v, a, s.

    Ids are chosen first, those of least hash, among the ids that have a label and a
    row; so only the terms of chosen rows are sent.  Of several rows of an id the one
    of least terms counts, and of several labels the smallest.
    """
    chosen = labels.where(col(id).isNotNull() & col(label).isin(0, 1)).groupBy(col(id).alias("of id")).agg(
        F.min(col(label)).alias("v"))
    here = rows.select(col(id).alias("here"))
    least = chosen.join(here, F.col("of id") == F.col("here"), "left_semi").select(
        F.xxhash64("of id").alias("h"), "of id", "v").orderBy("h", "of id").limit(sample)
    # At most `sample` rows of an id and a label.
    found = rows.select(col(id).alias("i"), F.struct(col(at).alias("a"), col(share).alias("s")).alias("x")).join(
        F.broadcast(least), F.col("i") == F.col("of id")).groupBy("h", "i", "v").agg(F.min("x").alias("x"))
    return sorted(found.select("h", "i", "v", "x.a", "x.s").collect(), key=lambda r: (r["h"], r["i"]))


def _units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def score(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS,
          carry: list[str] | None = None) -> DataFrame:
    """The frame with `score`, the similarity-weighted share of label 1 among the
    nearest labelled documents.  Documents as near as the last of these vote too.

    `labels` has the id and the label, 0 or 1; rows with nulls are left out, and
    of several labels of an id the smallest counts.  Without labelled documents
    every score is 0.5; a text without words, or unlike every labelled one, gets
    the share of label 1 in the sample.  A column named `score` is replaced.
    `carry` names the columns to keep, all by default; what is kept is written once.
    """
    kept = [c for c in others(df, ["score"]) if carry is None or c in carry]
    at, share = free_name(df, "term_at"), free_name(df, "term_share")
    own_id = free_name(df, "term_id")
    sent = df.select(*map(col, kept), *([] if text in kept else [col(text)]), col(id).alias(own_id))
    made = terms(sent, at, share, text)
    rows = written(made if text in kept else made.drop(text), "terms")
    frequencies, n_rows = document_frequencies(rows, at)
    weights = (np.log((1 + n_rows) / (1 + frequencies)) + 1).astype(np.float32)
    chosen = labels.withColumnRenamed(id, own_id)
    known = labelled_sample(rows, chosen, own_id, at, share, label, sample)
    votes = np.array([r["v"] for r in known], np.float32)
    base = float(votes.mean()) if len(votes) else 0.5
    if known:
        points = _units(_dense([bytes(r["a"]) for r in known], [bytes(r["s"]) for r in known]) * weights)
        values, axes = np.linalg.eigh(points.T @ points)
        axes = axes[:, np.argsort(values)[::-1][:dimensions]].astype(np.float32)
        latent = _units(points @ axes)
        shared = df.sparkSession.sparkContext.broadcast((weights, axes, latent, votes))
    else:
        shared = df.sparkSession.sparkContext.broadcast(None)

    def start():
        model = shared.value

        def block(ats, shares):
            scale, axes, latent, votes = model
            vectors = _units((_dense(ats, shares) * scale) @ axes)
            cosine = vectors @ latent.T
            k = min(neighbours, len(votes))
            # Equal cosines at the border all vote, so no order among them matters.
            border = np.partition(cosine, len(votes) - k, axis=1)[:, len(votes) - k]
            row, near = np.nonzero(cosine >= np.maximum(border, np.float32(1e-6))[:, None])
            close = cosine[row, near]
            weight = np.exp(SHARPNESS * (close - cosine.max(axis=1)[row]))
            total = np.bincount(row, weight, len(cosine))
            share = np.bincount(row, weight * votes[near], len(cosine))
            return np.where(total > 0, share / np.where(total > 0, total, 1), base)

        def run(ats, shares):
            ats, shares = ats.to_pylist(), shares.to_pylist()
            if model is None:
                return [pa.array(np.full(len(ats), base))]
            made = [block(ats[i:i + 512], shares[i:i + 512]) for i in range(0, len(ats), 512)]
            return [pa.array(np.clip(np.concatenate(made).astype(np.float64), 0, 1))]
        return run

    scored = map_columns(rows, [at, share], T.StructType([T.StructField("score", T.DoubleType())]), start)
    return scored.drop(at, share, own_id)

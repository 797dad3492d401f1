"""Language-model scores of whole texts, beside a unigram base.

Texts are sequences of words (A-Z lower-cased, split at ASCII white space) and
one end.  The base is the smoothed unigram probability of the words.  The model
is the causal self-attention of `attention` over the subword ids of the words; a
text is cut into overlapping windows in which every id is scored once.

One pass over the texts to learn from counts all words and all pairs of adjacent
ids, and keeps every window.  The counts give the model its tables; the windows
train it in rounds.  Windows are dealt over the rounds, so each is trained on
once; in a round each task trains on its part, and parameters are averaged
weighted by windows.  Words, pairs, windows and gradients all come from the whole
corpus, so they grow with it.

Words more frequent than one in `1 / HOT_SHARE` are looked up in the tasks that
score: by that rule there are at most HOT_SHARE of them.  The other words go
through a join, which has the counts of all words.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm import attention, jvm_kernel
from taskframe.llm.frames import col, drop_tables, free_name, map_columns, noted, others, slices, written

# Subword ids, the end among them; the published split pattern is a fixed value.
SIZE = 2048
END = SIZE - 1
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words at least this frequent are broadcast: 1 / HOT_SHARE of all tokens.
HOT_SHARE = 1 << 18
ROUNDS, RATE, BATCH = 3, 0.01, 256
SMOOTH, PARTS = 0.1, 8
# Windows of a training task at least, while there are as many.
TASK_WINDOWS = 32768
CACHE_ENTRIES, CACHE_LENGTH = 500_000, 64
# Windows of a text that stand in one row.
RUN = 16
# Words whose counts a task holds before it hands them on.
HELD_WORDS = 300_000


class Subwords:
    """Subword ids of words: the first ids of a ranked vocabulary, and an end."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "subwords", pat_str=PATTERN, mergeable_ranks={t: r for t, r in ranks.items() if r < END},
            special_tokens={}, explicit_n_vocab=END)
        # Ids that begin with a space: a word's first one, and no other of its ids.
        self.spaced = np.zeros(END, bool)
        self.spaced[[r for t, r in ranks.items() if r < END and t[:1] == b" "]] = True
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, two bytes each."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        made = [*map(self.known.get, words)]
        fresh = [n for n, ids in enumerate(made) if ids is None]
        if fresh:
            new = [words[n] for n in fresh]
            self.learn(new)
            for n, w in zip(fresh, new, strict=True):
                made[n] = self.known[w]
            self.forget(new)
        return made

    def learn(self, words: Iterable[bytes]) -> None:
        """Distinct words."""
        encode, known = self.encoding.encode_ordinary, self.known
        plain = [w for w in words if w not in known]
        text = b" ".join(plain).decode()
        # Other white space inside would meet the space before the next word.
        if len(text.split()) != len(plain):
            odd = [w for w in plain if len(w.decode().split()) != 1]
            self.known.update((w, array("H", encode(" " + w.decode())).tobytes()) for w in odd)
            plain = [w for w in plain if w not in known]
            text = b" ".join(plain).decode()
        if plain:
            # No token reaches over the space before a word, so one text has the ids of all.
            ids = np.array(encode(" " + text), np.uint16)
            starts, raw = (2 * np.flatnonzero(self.spaced[ids])).tolist(), ids.tobytes()
            self.known.update(zip(plain, (raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)),
                                  strict=True))

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of a text's words, all learned before, and the end."""
        raw = b"".join(map(self.known.__getitem__, words))
        return np.r_[np.frombuffer(raw, "<u2"), np.uint16(END)].astype(np.int32)

    def forget(self, words: Iterable[bytes]) -> None:
        for w in words:
            if len(w) > CACHE_LENGTH:
                del self.known[w]


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


class Words:
    """The words of texts, each with its end (the empty word): the distinct words, and
    which of them stand in the texts, one text after another."""

    def __init__(self, texts: pa.Array) -> None:
        lower = pc.ascii_lower(pc.fill_null(texts, ""))
        parts = pc.ascii_split_whitespace(lower)
        found, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64)
        # White space at the borders of a text leaves empty parts.
        real = pc.greater(pc.binary_length(found), 0)
        ends = np.cumsum(sizes)
        before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
        sizes = before[ends] - before[ends - sizes]
        coded = found.filter(real).dictionary_encode()
        kind = pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()
        self.distinct = pa.concat_arrays([coded.dictionary.cast(kind), pa.array([b""], kind)])
        self.end = len(self.distinct) - 1
        # How many words each text has, its end among them, and where it starts.
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes), self.end)
        self.list = self.distinct.to_numpy(zero_copy_only=False).tolist()

    def flat_ids(self, codec: Subwords) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each has."""
        raw = pa.array([*codec.of(self.list[:-1]), END.to_bytes(2, "little")], pa.large_binary())
        found = raw.take(pa.array(self.codes))
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] // 2
        flat = np.frombuffer(found.buffers()[2] or b"", "<u2")[ends[0]:ends[-1]]
        return flat, np.diff(ends[np.r_[0, self.starts + self.sizes]])

    def texts_ids(self, codec: Subwords) -> list[np.ndarray]:
        """The ids of each text."""
        flat, sizes = self.flat_ids(codec)
        return np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1])[:len(sizes)]


class WordCounts:
    """Words with counts; a word may stand in several of the arrays that were added."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        self.words.append(words.cast(pa.large_binary()))
        self.counts.append(counts)
        self.size += len(words)

    def summed(self) -> tuple[pa.Array, np.ndarray]:
        """Every word once."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        counts = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(counts, coded.indices.to_numpy(), np.concatenate(self.counts))
        self.words, self.counts, self.size = [coded.dictionary], [counts], len(counts)
        return coded.dictionary, counts

    def taken(self) -> tuple[pa.Array, np.ndarray]:
        words, counts = self.summed()
        self.__init__()
        return words.cast(pa.binary()), counts


_CORPUS = T.StructType([
    T.StructField("word", T.BinaryType()), T.StructField("pair", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("window", T.BinaryType()),
    T.StructField("deal", T.IntegerType())])


def gather(texts: DataFrame, path: str) -> DataFrame:
    """Words and id pairs with counts, not yet summed, and training windows.

    The end is the empty word.  A window row is a run of `attention.runs`, n its windows;
    `deal` counts the windows of a task, from a place of the task's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, words, pairs = subwords(path), WordCounts(), np.zeros(SIZE * SIZE, np.int64)
        dealt = TaskContext.get().partitionId()

        def made(word=None, n=None, pair=None, window=None, deal=None) -> pa.RecordBatch:
            if window is not None:
                # All rows are of one width, so their borders are known.
                borders = np.arange(len(window) + 1, dtype=np.int32) * np.int32(window.strides[0])
                window = pa.Array.from_buffers(
                    pa.binary(), len(window), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(window))])
            columns = [(word, pa.binary()), (pair, pa.int64()), (n, pa.int64()), (window, pa.binary()),
                       (deal, pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(n), kind) if c is None else c if isinstance(c, pa.Array) else pa.array(c, kind)
                 for c, kind in columns],
                _CORPUS.fieldNames())

        for batch in batches:
            for part in slices(batch):
                found = Words(part.column(0))
                flat, sizes = found.flat_ids(codec)
                words.add(found.distinct, np.bincount(found.codes, minlength=len(found.distinct)))
                # Each text ends with END, which also comes before the next one's first id.
                np.add.at(pairs, np.r_[np.int32(END), flat[:-1]] * np.int32(SIZE) + flat.astype(np.int32), 1)
                rows, n = attention.runs(flat, sizes, END, RUN)
                ends = dealt + np.cumsum(n)
                yield made(window=rows, n=n, deal=((ends - n) % (1 << 30)).astype(np.int32))
                dealt = int(ends[-1])
                if words.size > 2 * HELD_WORDS and len(words.summed()[0]) > HELD_WORDS:
                    yield made(*words.taken())
        if words.size:
            yield made(*words.taken())
        keys = np.flatnonzero(pairs)
        if len(keys):
            yield made(pair=keys, n=pairs[keys])

    return texts.mapInArrow(run, _CORPUS)


_PARAMETERS = "at long, part binary, weight long"


def _flat(p: attention.Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: attention.Parameters) -> attention.Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def fit(windows: DataFrame, tables: attention.Tables, rounds: int, rate: float,
        kernel: jvm_kernel.Kernel | None = None) -> attention.Parameters:
    """Parameters trained on all windows, each in one round; a round averages what
    its tasks made.

    `windows` has window (a run), deal and n.  The tasks' parameters are summed in PARTS tasks, of one row each at a
    time, and the driver adds those sums.  Without a kernel the tasks train in numpy.
    """
    spark, p = windows.sparkSession, attention.initial(SIZE)
    # An average of tasks that saw little is worth little: few windows, few tasks.
    tasks = max(1, (windows.agg(F.sum("n")).first()[0] or 0) // (rounds * TASK_WINDOWS))
    context = spark.sparkContext
    given = None if kernel else context.broadcast(tables)
    for turn in range(rounds):
        shared, step = None if kernel else context.broadcast(p), rate / (turn + 1)

        def run(batches, shared=shared, step=step, turn=turn):
            own, tables = {k: v.copy() for k, v in shared.value.items()}, given.value

            def grouped():
                held = None
                for batch in batches:
                    column, deal = batch.column(0), batch.column(1).to_numpy()
                    raw = column.buffers()[2]
                    if raw is None:
                        continue
                    # All of one width, and none is null.
                    rows = np.frombuffer(raw, "<i2").reshape(-1, 2 + attention.CONTEXT + RUN * attention.STRIDE)
                    made = attention.of_runs(rows[column.offset:column.offset + len(column)], deal, turn, rounds, END)
                    held = made if held is None else tuple(map(np.concatenate, zip(held, made, strict=True)))
                    whole = len(held[1]) // BATCH * BATCH
                    for at in range(0, whole, BATCH):
                        yield tuple(x[at:at + BATCH] for x in held)
                    held = tuple(x[whole:] for x in held)
                if held and len(held[1]):
                    yield held

            seen = attention.train(own, tables, grouped(), step)
            if seen:
                # Weighted, so that what follows only adds.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % PARTS]),
                     pa.array([(_flat(own).astype("<f8") * seen).tobytes()]), pa.array([seen])],
                    ["at", "part", "weight"])

        def add(batches):
            total, weight = None, 0
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["part"], "<f8")
                    total, weight = (x.copy() if total is None else total + x), weight + row["weight"]
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0]), pa.array([total.tobytes()]), pa.array([weight])], ["at", "part", "weight"])

        dealt = windows.select("window", "deal").coalesce(tasks)
        if kernel:
            made = kernel.learn(dealt, _PARAMETERS, _flat(p), (turn, rounds), RUN, BATCH, PARTS, END, step)
        else:
            made = dealt.mapInArrow(run, _PARAMETERS)
        sums = made.repartition(PARTS, "at").mapInArrow(add, _PARAMETERS).collect()
        if not sums:
            continue
        weight = sum(r["weight"] for r in sums)
        p = _shaped(sum(np.frombuffer(r["part"], "<f8") for r in sums) / weight, p)
    return p


def score(df: DataFrame, trained: Column, path: str, text: str = "text", rounds: int = ROUNDS,
          rate: float = RATE) -> DataFrame:
    """The frame with n_tokens, n_known, train_tokens (long), base_score and score
    (log10 probabilities).

    Only rows where `trained` is true are learned from.  A null text is empty: it
    is one end token.  Without any row to learn from, the base is zero and the
    model is untrained.  `path` is a ranked vocabulary whose first ids are the
    subwords.  Columns of the new names are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = others(df, new)
    spark = df.sparkSession
    gathered: list[str] = []
    with noted(gathered):
        corpus = written(gather(df.where(trained).select(col(text)), path), "corpus")
    counts = written(corpus.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # One row per distinct pair, at most SIZE * SIZE of them.
    found = corpus.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(SIZE * SIZE)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    tables = attention.Tables(pairs.reshape(SIZE, SIZE))
    kernel = jvm_kernel.kernel(spark, tables)
    p = fit(corpus.where("window is not null").select("window", "deal", "n"), tables, rounds, rate, kernel)
    # Nothing below reads the windows, which take more room than the texts.
    drop_tables(gathered, counts)
    hot = counts.where(F.col("n") * HOT_SHARE >= total).toArrow()
    logs = np.log10((hot.column("n").to_numpy() + SMOOTH) / (total + SMOOTH * (distinct + 1)))
    frequent = hot.column("word").combine_chunks().cast(pa.large_binary())
    shared = spark.sparkContext.broadcast((None if kernel else (p, tables), frequent, np.r_[logs, 0.0]))
    row, rare, base, known, ids = (free_name(df, f"lm_{x}") for x in ("row", "rare", "base", "known", "ids"))

    def start():
        model, frequent, logs = shared.value
        table, codec = attention.table_of(model[0]) if model else None, subwords(path)

        def scored(found):
            if model:
                p, tables = model
                return attention.log_probabilities(p, table, tables, found.texts_ids(codec), END)
            flat, sizes = found.flat_ids(codec)
            borders = np.r_[0, 2 * np.cumsum(sizes)].astype(np.int32)
            return pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(borders), pa.py_buffer(flat)])

        def run(texts):
            found = Words(texts)
            scores = scored(found)
            unknown, n = len(frequent), len(found.sizes)
            at = pc.fill_null(pc.index_in(found.distinct.cast(pa.large_binary()), frequent), unknown)
            at = at.to_numpy().astype(np.int64).take(found.codes)
            text = np.repeat(np.arange(n), found.sizes)
            bases = np.bincount(text, logs.take(at), n)
            miss = np.flatnonzero(at == unknown)
            knowns = found.sizes - np.bincount(text.take(miss), minlength=n)
            # Per text, each of its other words once, with its number.
            both, times = np.unique(text.take(miss) * len(found.list) + found.codes.take(miss), return_counts=True)
            borders = np.searchsorted(both, np.arange(n + 1) * len(found.list)).astype(np.int32)
            rares = pa.StructArray.from_arrays(
                [found.distinct.take(pa.array(both % len(found.list))).cast(pa.binary()), pa.array(times, pa.int64())],
                ["word", "n"])
            return [pa.array(found.sizes, pa.int64()), scores if isinstance(scores, pa.Array) else pa.array(scores), pa.array(bases, pa.float64()),
                    pa.array(knowns, pa.int64()), pa.ListArray.from_arrays(pa.array(borders), rares)]
        return run

    entry = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    made = map_columns(df.select(*map(col, kept)), [text], T.StructType([
        T.StructField("n_tokens", T.LongType()),
        T.StructField(ids, T.BinaryType()) if kernel else T.StructField("score", T.DoubleType()),
        T.StructField(base, T.DoubleType()), T.StructField(known, T.LongType()),
        T.StructField(rare, T.ArrayType(entry))]), start)
    if kernel:
        made = made.withColumn("score", kernel.score(F.col(ids), _flat(p), END)).drop(ids)
    rows = written(made.withColumn(row, F.monotonically_increasing_id()), "scored")
    each = rows.select(F.col(row).alias("row"), F.explode(rare).alias("x")).select("row", "x.word", "x.n")
    seen = counts.where(F.col("n") * HOT_SHARE < total).select("word", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    log = F.log10((c + SMOOTH) / (F.lit(float(total)) + SMOOTH * (distinct + 1)))
    sums = each.join(seen, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * log).alias("rare_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    joined = rows.join(sums.withColumnRenamed("row", "of row"), F.col(row) == F.col("of row"), "left")
    return joined.select(
        *map(col, kept), "n_tokens",
        (F.col(known) + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col(base) + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")

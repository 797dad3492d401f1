"""The Java passes of attention against numpy; windows in runs; counts of words."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskframe.llm import attention, jvm_kernel, lm_scoring, queries

PATH = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
END, SIZE = lm_scoring.END, lm_scoring.SIZE
SIZES = [1, 2, 15, 16, 17, 255, 256, 257, 300, 900]


def some_texts(seed: int, sizes=SIZES) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.r_[(rng.random(n - 1) ** 3 * END).astype(np.int32), np.int32(END)] for n in sizes]


def some_tables() -> attention.Tables:
    rng = np.random.default_rng(4)
    return attention.Tables((rng.random((SIZE, SIZE)) ** 8 * 20).round())


@pytest.fixture(scope="module")
def made(spark):
    tables = some_tables()
    kernel = jvm_kernel.kernel(spark, tables)
    if kernel is None:
        pytest.skip("no Java compiler or vector module")
    return tables, kernel


def test_runs_hold_all_windows_in_order():
    texts = some_texts(1)
    sizes = np.array([len(t) for t in texts])
    for length in (1, 3, lm_scoring.RUN):
        rows, n = attention.runs(np.concatenate(texts).astype(np.uint16), sizes, END, length)
        ids, ahead, targets, weight, _ = attention.windows(texts, END)
        assert len(rows) == sum(-(-len(t) // (16 * length)) for t in texts) and n.sum() == len(ids)
        deal = 5 + np.cumsum(n) - n
        for turn in range(3):
            mine = (5 + np.arange(len(ids))) % 3 == turn
            found = attention.of_runs(rows, deal, turn, 3, END)
            for x, y in zip(found, (ids, ahead, np.where(weight > 0, targets, 0), weight), strict=True):
                assert np.array_equal(x, y[mine])


def test_a_text_hands_on_runs_and_each_pair_once(spark):
    """Before, a row per window, and pairs of a task as often as it had held enough."""
    words = [f"w{n % 7} x{n}" for n in range(400)]
    texts = spark.createDataFrame([(" ".join(words),), (None,), ("",)], "text string").coalesce(1)
    rows = lm_scoring.gather(texts, PATH).collect()
    codec = lm_scoring.Subwords(PATH)
    ids = [*lm_scoring.Words(pa.array([" ".join(words)])).texts_ids(codec)[0].tolist()]
    runs = [r for r in rows if r.window is not None]
    assert len(runs) == -(-len(ids) // (16 * lm_scoring.RUN)) + 2 and sum(r.n for r in runs) == -(-len(ids) // 16) + 2
    pairs = Counter(zip([END, *ids], ids))
    pairs[END, END] += 2
    assert {r.pair: r.n for r in rows if r.pair is not None} == {a * SIZE + b: n for (a, b), n in pairs.items()}
    assert sum(r.pair is not None for r in rows) == len(pairs)
    counts = Counter(w.encode() for t in words for w in t.split()) + Counter({b"": 3})
    assert {bytes(r.word): r.n for r in rows if r.word is not None} == counts


def test_word_counts_of_several_parts():
    held, counts, rng = lm_scoring.WordCounts(), Counter(), random.Random(2)
    for part in range(6):
        words = rng.sample([b"", b"a", b"\xc3\xa4", b"bc", b"d" * 300], 4)
        numbers = [rng.randrange(1, 9) for _ in words]
        held.add(pa.array(words, pa.binary() if part % 2 else pa.large_binary()), np.array(numbers))
        counts.update(dict(zip(words, numbers)))
        if part == 3:
            held.summed()
    words, numbers = held.taken()
    assert dict(zip(words.to_pylist(), numbers.tolist())) == counts and held.size == 0


def test_java_trains_as_numpy(spark, made):
    tables, kernel = made
    texts = some_texts(2, SIZES * 6)
    rows, n = attention.runs(np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts]), END, lm_scoring.RUN)
    deal = np.cumsum(n) - n
    windows = spark.createDataFrame(
        [(bytearray(r.tobytes()), int(d), int(k)) for r, d, k in zip(rows, deal, n)], "window binary, deal int, n long").coalesce(1)
    assert 3 * lm_scoring.BATCH < n.sum()
    for rounds in (1, 2):
        by_numpy = lm_scoring.fit(windows, tables, rounds, 0.01)
        by_java = lm_scoring.fit(windows, tables, rounds, 0.01, kernel)
        start = attention.initial(SIZE)
        for k, x in by_numpy.items():
            assert np.abs(x - start[k]).max() > 1e-3, k
            assert np.allclose(x, by_java[k], atol=5e-4), (rounds, k, np.abs(x - by_java[k]).max())


def test_java_scores_as_numpy(spark, made):
    """Also where scores lie far apart."""
    tables, kernel = made
    texts = some_texts(3)
    frame = spark.createDataFrame([(bytearray(t.astype("<u2").tobytes()),) for t in texts], "ids binary").coalesce(1)
    for scale in (1, 12):
        p = {k: v * np.float32(scale) for k, v in attention.initial(SIZE).items()}
        want = attention.log_probabilities(p, attention.table_of(p), tables, texts, END)
        got = [r[0] for r in frame.select(kernel.score(F.col("ids"), lm_scoring._flat(p), END)).collect()]
        assert got == pytest.approx(want.tolist(), rel=1e-4)


def test_a_gradient_that_is_not_finite_fails(spark, made):
    _, kernel = made
    rows, n = attention.runs(np.array([3, 4, END]), np.array([3]), END, lm_scoring.RUN)
    windows = spark.createDataFrame([(bytearray(rows[0].tobytes()), 0)], "window binary, deal int")
    flat = lm_scoring._flat(attention.initial(SIZE)) * np.float32(np.nan)
    trained = kernel.learn(windows, lm_scoring._PARAMETERS, flat, (0, 1), lm_scoring.RUN, lm_scoring.BATCH, 8, END, 0.01)
    with pytest.raises(Exception, match="gradient is not finite"):
        trained.collect()


def test_without_a_compiler_numpy_gives_the_scores(spark, made, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "ing", "ed", "s")]
    texts = spark.createDataFrame(
        [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(40)], "doc_id long, text string").coalesce(1)

    def scores():
        rows = lm_scoring.score(texts, F.col("doc_id") % 5 != 0, PATH).collect()
        return {r.doc_id: r for r in rows}

    with_kernel = scores()
    monkeypatch.setattr(jvm_kernel, "_maker", lambda spark: (_ for _ in ()).throw(RuntimeError("no compiler")))
    monkeypatch.setattr(jvm_kernel, "_makers", {})
    with pytest.warns(UserWarning, match="numpy"):
        without = scores()
    assert with_kernel.keys() == without.keys()
    for k, r in without.items():
        assert r.score == pytest.approx(with_kernel[k].score, rel=1e-3)
        assert (r.base_score, r.n_known) == (with_kernel[k].base_score, with_kernel[k].n_known)

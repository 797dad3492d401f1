"""Alignment, window packing and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskframe.llm import (
    alignment, attention, classifier, frames, licenses, lm_scoring, nnls_packing, packing, pii, queries, spelling,
)

BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = queries.tokenizer_path("piece_bpe_32k.model")
WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")
random.seed(9)
SYLLABLES = ["th", "on", "er", "La", "ció", "ung", "ê", "9", ".", "###", "!!", "ß", "漢", "😀", "===="]
PROSE = ["".join(random.choices([*SYLLABLES, " ", " ", "\n", "  ", "\t", " ", "\x1c", " "], k=random.randint(1, 200)))
         for _ in range(80)]
ODD = [None, "", " ", "  ", "\n\n", "a", "a  b", " a", "a ", "x<|endoftext|>y", "</s> <s>", "É É", "don't 's",
       "▁x", "a ▁ b", "\x00 a", "=" * 3000, "ab" * 2000, "word " * 9000, "same words again", "same words again"]
SCHEMA = "doc_id long, text string, n_a string, length string, word string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD + PROSE)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id at all", None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    bytes_of = alignment.Tokenizers(BYTE_BPE, PIECES)
    out = []
    for text in texts:
        ids_a = a.encode(" " + text).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = [[t[i] for i in ids] for t, ids in ((bytes_of.bytes_a, ids_a), (bytes_of.bytes_b, ids_b))]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append([])
            continue
        ends_a, ends_b = (np.cumsum(list(map(len, r))).tolist() for r in raw)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        out.append(groups)
    return out


def test_alignment(docs, empty):
    rows = alignment.with_counts(docs, BYTE_BPE, PIECES).collect()
    found = brute_alignment([r.text for r in rows])
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in found]
    count = Counter(p for each in links for p in each)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for r, groups, each in zip(rows, found, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if groups else ""), repr(r.text)[:60]
        want = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(each.values()),
                sum(m for p, m in each.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in each.items()))
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want, repr(r.text)[:60]
    assert [r.groups_sha256 for r in rows if r.text in (None, "", "▁x")] == [""] * 3
    assert alignment.with_counts(empty, BYTE_BPE, PIECES).count() == 0
    assert "doc_id" in alignment.with_counts(docs, BYTE_BPE, PIECES).columns


def test_rare_pairs_are_joined(docs, monkeypatch):
    whole = alignment.with_counts(docs, BYTE_BPE, PIECES).select("doc_id", *alignment.NAMES).collect()
    monkeypatch.setattr(alignment, "HOT_SHARE", 50)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 10)
    again = alignment.with_counts(docs, BYTE_BPE, PIECES).select("doc_id", *alignment.NAMES).collect()
    assert Counter(whole) == Counter(again)


def test_terminals_of_tokens_out_of_step():
    """One group of many tokens, none of which ends with another before the last."""
    ends_a = np.r_[np.arange(4, 4000, 4), 4000]
    ends_b = np.r_[np.arange(2, 4000, 4), 4000]
    assert (alignment.terminals(ends_a, ends_b) == len(ends_a) - 1).all()
    assert alignment.terminals(np.arange(1, 4), np.arange(1, 4)).tolist() == [0, 1, 2, 0, 1, 2]


def check_windows(rows, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for doc, parts in by_doc.items():
        copies = [t for i, t in texts if i == doc]
        ids = library.encode(copies[0] or "", add_special_tokens=False).ids + [2]
        want = Counter(range(len(ids)))
        got = Counter()
        for r in parts:
            assert bytes(r.ids) == np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 > 0
            got.update(range(r.start, r.start + r.length))
        assert got == Counter({k: n * len(copies) for k, n in want.items()})
    assert set(by_doc) == {i for i, _ in texts}
    for parts in by_window.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return by_window


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_windows_are_full(docs, empty, capacity):
    rows = nnls_packing.pack(docs, WORD_BPE, capacity, 2)
    assert rows.columns == ["doc_id", "n_a", "word", *nnls_packing.NEW]
    check_windows(rows.collect(), [(r.doc_id, r.text) for r in docs.collect()], capacity)
    assert nnls_packing.pack(empty, WORD_BPE, capacity, 2).count() == 0


def test_window_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {}
    rows = queries.QUERIES["op12_nnls_packing"](spark, folder).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    for i, t in texts:
        want[i] = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][4 * r.start:4 * (r.start + r.length)]) for r in rows)
    assert sum(r.length for r in rows) * 4 == sum(map(len, want.values()))


def test_plans_keep_every_copy():
    rng = np.random.default_rng(3)
    for capacity in (8, 64, 1000):
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, rng.integers(1, 30))
            histogram = dict(zip(sizes.tolist(), rng.integers(1, 400, len(sizes)).tolist()))
            where = nnls_packing.plan(histogram, capacity)
            size = np.repeat(list(histogram), list(histogram.values()))
            rank = np.concatenate([np.arange(n) for n in histogram.values()])
            piece, begin, end, sequence, offset = where.placed(size, rank)
            assert np.bincount(piece, end - begin).tolist() == size.tolist()
            cells = np.concatenate([s * capacity + np.arange(o, o + e - b) for s, o, b, e in zip(
                sequence.tolist(), offset.tolist(), begin.tolist(), end.tolist())])
            assert len(np.unique(cells)) == len(cells)
            used = np.bincount(sequence, end - begin).astype(int)
            assert all(u == capacity or u & (u - 1) == 0 for u in used.tolist())
            assert used.sum() == size.sum()


def test_least_squares_is_non_negative_and_least():
    lengths, repeats = nnls_packing.combinations(np.array([1, 2, 3, 5, 8]), np.array([40, 30, 9, 50, 7]), 8)
    assert ((lengths * repeats).sum(axis=1) == 8).all()
    wanted = np.array([0, 40, 30, 9, 0, 50, 0, 0, 7.0])
    x = nnls_packing.least_squares(lengths, repeats, wanted, 5000)
    a = np.zeros((9, len(lengths)))
    for c, (s, n) in enumerate(zip(lengths, repeats)):
        np.add.at(a[:, c], s, n)
    gradient = a.T @ (a @ x - wanted)
    assert (x >= 0).all() and (gradient > -1e-3).all() and (np.abs(gradient[x > 1e-3]) < 1e-3).all()


def test_special_strings_in_other_case():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|ENDOFTEXT|> b", "x<|EndOfText|>y", "<|endoftext|>", "<|STARTOFTEXT|>.", "İ<|ENDOFTEXT|>", "<|endOftext|>!?"]
    ids = packing.WordIds(WORD_BPE, 7).ids(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def brute_variants(counts, least_length, least_count, ratio):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def brute_counts(rows, modulus):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return out


@pytest.mark.parametrize("modulus", [2, 199])
def test_word_counts(docs, empty, modulus, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    got = {r.word: r.n for r in spelling.word_counts(docs, "doc_id", modulus=modulus).collect()}
    assert got == brute_counts([(r.doc_id, r.text) for r in docs.collect()], modulus)
    assert spelling.word_counts(empty, "doc_id").count() == 0


@pytest.mark.parametrize("tile", [2, 256])
def test_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = random.Random(tile)
    counts = {"kettle": 5000, "ketle": 700, "ketlé": 100, "kele": 20, "klee": 3, "a": 10, "b": 60, "é": 2000, "": 9}
    for _ in range(500):
        counts["".join(rng.choices("abé", k=rng.randint(1, 7)))] = rng.choice([3, 5, 5, 30, 200, 2000])
    for a in "abcdefghijklmnop":
        for b in "abcdefghijklmnop":
            counts[f"long{a}{b}ness"] = rng.choice([5, 25, 40])
    counts |= {"x" * 5000: 10, "x" * 5001: 60, "x" * 4999 + "y": 50}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    for least_length, ratio in ((1, 5), (6, 2)):
        rows = spelling.variants(frame, least_length, 5, ratio).collect()
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
        assert got == brute_variants(counts, least_length, 5, ratio) and len(rows) == len(got)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_spelling_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = brute_counts(texts, 199)
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = Counter()
    deleted = defaultdict(set)
    for w in want:
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            deleted[v].add(w)
    pairs = {(a, b) for group in deleted.values() for a in group for b in group if a < b and distance_one(a, b)}
    for a, b in pairs:
        near[a] += 1
        near[b] += 1
    rows = queries.QUERIES["op13_spelling"](spark, folder).collect()
    assert {r.word: (r.n, r.n_near) for r in rows} == {w: (n, near[w]) for w, n in want.items()}
    assert len(rows) == len(want) and all(r.form is None or r.form_n >= 5 * r.n for r in rows)


def pseudonyms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_long_runs_are_no_danger(spark):
    card = "4111 1111 1111 1111"
    texts = ["7" * 10**6, "1234 " * 20_000 + card, "x" * 10**6, "a@" + "b." * 50_000, "12-" * 100_000, "9 " * 50_000,
             f"{'5' * 3000} {card}", f"{'3' * 1000} 4111111111111111 2024-01-02"]
    got = pseudonyms(spark, texts)
    assert got[0] == texts[0] and got[2] == texts[2] and got[4] == texts[4]
    assert got[1][-len(card):] != card and len(got[1]) == len(texts[1])
    assert card not in got[6] and got[6].startswith("5" * 3000) and luhn(re.sub(" ", "", got[6][3001:]))
    assert "4111111111111111" not in got[7] and "2024-01-02" not in got[7]


def test_secrets_whole_and_distinct(spark):
    texts = ["token=Ab12Cd", "token=ab12cd", "x token=Ab12Cd y", "password=abcd!efgh9", "password: p@ssw0rd!",
             "api_key = 'k-1!2#3'", "secret=wxyz1234. Then", "token = abc"]
    got = pseudonyms(spark, texts)
    assert got[0] != got[1] and got[2] == f"x {got[0]} y" and got[7] == texts[7]
    assert not any(x in got[3] + got[4] + got[5] for x in ("efgh9", "p@ss", "rd!", "2#3"))
    assert got[6].endswith(". Then") and "wxyz" not in got[6] and [len(g) for g in got] == [len(t) for t in texts]


def test_international_phones(spark):
    texts = ["+49 30 1234567", "+44 20 7946 0958", "call +49 30 1234567 now", "+1 555 123 4567", "+33 1 23 45", "+12345"]
    got = pseudonyms(spark, texts)
    assert all(g != t and re.sub("[0-9]", "0", g) == re.sub("[0-9]", "0", t) for g, t in zip(got[:4], texts[:4]))
    assert got[2] == f"call {got[0]} now" and got[5] == texts[5]


def scanned(text):
    """An independent scanner: the cards, numbers and addresses that must not stay."""
    found = set(re.findall(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", text))
    found = {s for s in found if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"}
    found |= set(re.findall(r"[\w.%+-]+@[\w-]+\.[\w.-]*\w", text))
    for m in re.finditer(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9 -])[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -]?[0-9])", text):
        if luhn(re.sub("[^0-9]", "", m[0])):
            found.add(m[0])
    return found


def test_nothing_that_a_scanner_finds_stays(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    after = {r.doc_id: r.text for r in pii.pseudonymise(documents, "key").collect()}
    seen = 0
    for r in documents.collect():
        mine = scanned(r.text or "")
        seen += len(mine)
        assert not [x for x in mine if x in (after[r.doc_id] or "")]
    assert seen > 20


def test_labelled_sample_is_chosen_by_id(spark):
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(300)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 500)] + [(100, 1), (101, None)], "doc_id long, quality int")
    made = classifier.terms(docs, "at", "share")

    def chosen(n):
        return classifier.labelled_sample(made, labels, "doc_id", "at", "share", "quality", n)

    rows = chosen(50)
    assert len(rows) == len({r.i for r in rows}) == 50 and all(100 <= r.i < 300 and r.v == r.i % 2 for r in rows if r.i > 100)
    assert [r.h for r in rows] == sorted(r.h for r in rows)
    whole = chosen(5000)
    assert {r.i for r in whole} == set(range(100, 300)) - {101} | {101} and [r.i for r in whole[:50]] == [r.i for r in rows]
    assert classifier.score(docs, labels, carry=["doc_id"]).columns == ["doc_id", "score"]


def test_scratch_is_dropped_but_for_what_is_read(spark):
    paths, other = [], frames.written(spark.range(2), "test-drop")
    with frames.noted(paths):
        one, two = (frames.written(spark.range(n), "test-drop") for n in (3, 4))
    frames.drop_tables(paths, one)
    assert one.count() == 3 and other.count() == 2 and len(paths) == 1
    with pytest.raises(Exception):
        two.collect()


def test_equal_neighbours_all_vote(spark):
    docs = spark.createDataFrame([(i, "the very same words") for i in range(40)] + [(99, "the very same words")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, quality int")
    rows = classifier.score(docs, labels, neighbours=5).collect()
    assert {round(r.score, 4) for r in rows} == {0.25}


def names_in(text, scanner=licenses.Scanner(licenses.TEMPLATES)):
    return [x[0] for x in scanner.find(text)]


def test_license_expressions_and_names():
    assert names_in("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;") == ["MIT-SPDX", "Apache-2.0-SPDX"]
    assert names_in("SPDX-License-Identifier: (GPL-2.0+ AND BSD-3-Clause)") == ["GPL-2.0-plus-SPDX", "BSD-3-Clause-SPDX"]
    assert names_in("SPDX-License-Identifier: GPL-2.0\nor MIT") == ["GPL-2.0-SPDX"]
    assert names_in("SPDX-License-Identifier:") == [] and names_in("SPDX-License-Identifier: Nothing") == []
    assert names_in("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"]
    assert names_in("This is under a Creative Commons Attribution 4.0 International License.") == ["CC-BY-4.0-name"]
    assert names_in("Covered by the Mozilla Public License 2.0 here") == ["MPL-2.0-name"]
    assert names_in("Code is licensed under the GNU GPL v3") == ["GPL-3.0-license-name"]
    assert names_in("has waived all rights reserved to them by law") == []
    assert names_in("(c) Someone. All rights reserved.\nMore") == ["Proprietary"]


def test_compression_ranks_and_wording_confirms():
    """Of texts that hold each other, the whole one is found, with and without slips."""
    rng = random.Random(3)
    known = licenses.TEMPLATES
    for name in ("BSD-2-Clause-text", "BSD-3-Clause-text", "MIT-text", "GPL-3.0-or-later-notice", "GPL-3.0-or-later-header",
                 "Apache-2.0-header", "Apache-2.0-file-header", "MPL-2.0", "MPL-2.0-header"):
        assert names_in(f"Some words before. {known[name]} Some after.") == [name]
        changed = known[name].split()
        for i in rng.sample([i for i, w in enumerate(changed) if w.isalpha() and w.islower()], max(1, len(changed) // 25)):
            changed[i] = "other"
        assert names_in(" ".join(changed)) in ([name], [])
    two = f"{known['MIT-text']}\n\n{known['GPL-3.0-or-later-notice']}\n\n{known['MIT-text']}"
    assert names_in(two) == ["MIT-text", "GPL-3.0-or-later-notice", "MIT-text"]


def test_scan_of_documents_by_every_alignment(spark):
    """Brute force over whole tables: every template aligned with every text that may hold it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.x.license, r.x.differences) for r in licenses.scan(docs).select(
        "doc_id", F.explode("licenses").alias("x")).collect()}
    expected = set()
    templates = {n: licenses.words(t) for n, t in licenses.TEMPLATES.items()}
    for row in docs.collect():
        for line in (row.text or "").split("\n"):
            own = licenses.words(line)
            for name, asked in templates.items():
                if any(own[i:i + len(asked)] == asked for i in range(len(own) - len(asked) + 1)):
                    expected.add((row.doc_id, name, 0))
    assert expected and expected <= got
    assert {x for x in got if x[2] == 0} == expected


def test_ids_of_odd_words_are_the_librarys():
    """Batches in which any word may need a look of its own, and known words come again."""
    word_ids, rng = packing.WordIds(WORD_BPE, 1), random.Random(3)
    bits = ["a", "B", "z", "É", "é", "́", "Σ", "ς", "İ", "ſ", "ß", "Å", "Å", "1", "9", ".", ",", "!", "'", "'s", "<|endoftext|>",
            "<|EndOfText|>", "_", "-", "#", "…", "。", "中", "が", " ", " ", "\t", "\n", " ", " ", "\x85", "\x1c", "ﬁ", "🙂", "‍",
            "%", "$$", "the", "Theorem", "don'T", "Ͱ", "ɐ", "ǅ", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    for i in range(0, len(texts), 50):
        for text, got in zip(texts[i:i + 50], word_ids.ids(texts[i:i + 50]), strict=True):
            want = word_ids.tokenizer.encode(text, add_special_tokens=False).ids + [1]
            assert np.frombuffer(got, "<u4").tolist() == want, text
    assert word_ids.ids([]) == [] and len(word_ids.ids(["", " "])) == 2


def test_words_of_a_batch_are_those_of_each_text():
    """Distinct words and their ids against plain splitting; one text is encoded for all ordinary words."""
    rng = random.Random(5)
    signs = " \t\n\x0b\x0c\r\x1c\x85\xa0\u3000\u2028aAbZ's1²Äß-._中́\x00İ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(800)] + [None, "", " \n ", "a b"]
    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    plain = [(t or "").encode().lower().split() for t in texts]
    one = lm_scoring.Subwords(path)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["x y", *texts], kind).slice(1)
        found = lm_scoring.Words(column)
        assert found.sizes.tolist() == [len(r) + 1 for r in plain]
        assert [found.list[c] for c in found.codes] == [w for r in plain for w in [*r, b""]]
        for made, words in zip(found.texts_ids(lm_scoring.Subwords(path)), plain, strict=True):
            each = [one.encoding.encode_ordinary(" " + w.decode()) for w in words]
            assert made.tolist() == [i for ids in each for i in ids] + [lm_scoring.END]
    calls = []
    counted = lm_scoring.Subwords(path)
    counted.encoding = type("Counted", (), {"encode_ordinary": lambda _, t: calls.append(t) or one.encoding.encode_ordinary(t)})()
    counted.learn({f"word{n}".encode() for n in range(500)})
    assert len(calls) == 1 and len(counted.known) == 500
    assert [len(t) for t in lm_scoring.Words(pa.array([], pa.string())).texts_ids(one)] == []


def test_rows_are_summed_by_index():
    rng = np.random.default_rng(3)
    for n, size in ((0, 5), (1, 5), (700, 3), (5000, 900), (40_000, 40_000)):
        at = (rng.random(n) ** 3 * size).astype(np.int64)
        rows = np.r_[rng.integers(-9, 9, (n, 7)), np.zeros((1, 7))].astype(np.float32)
        summed = np.zeros((size, 7), np.float32)
        np.add.at(summed, at, rows[:n])
        assert np.array_equal(attention._gathered(at, rows, size), summed)


def test_gradients_are_those_of_the_scores(monkeypatch):
    """Against differences, with and without the greatest score taken away first."""
    rng = np.random.default_rng(8)
    size = 512
    tables = attention.Tables(rng.integers(0, 5, (size, size)).astype(float))
    p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.1) for k, v in attention.initial(size).items()}
    texts = [rng.integers(0, size, n) for n in (3, 20, 41)]
    ids, ahead, goals, weight, _ = attention.windows(texts, size - 1)

    def loss(p):
        logs = attention.Forward(attention.table_of(p), p, tables, ids, ahead, goals).log_probability()
        return -float((logs.astype(float) * weight).sum() / weight.sum())

    plain = attention.Forward(attention.table_of(p), p, tables, ids, ahead, goals)
    made = plain.gradients(p, weight)
    monkeypatch.setattr(attention, "_LARGE", -np.inf)
    careful = attention.Forward(attention.table_of(p), p, tables, ids, ahead, goals)
    assert np.allclose(plain.log_probability(), careful.log_probability(), atol=1e-4)
    for k, g in careful.gradients(p, weight).items():
        assert np.allclose(g, made[k], atol=1e-5), k
    for k, g in made.items():
        move = rng.standard_normal(g.shape).astype(np.float32)
        step = np.float32(0.0003)
        change = (loss(p | {k: p[k] + step * move}) - loss(p | {k: p[k] - step * move})) / (2 * float(step))
        assert change == pytest.approx(float((g * move).sum()), abs=2e-3, rel=0.05), k


def test_windows_are_dropped_before_texts_are_scored(spark):
    paths = []
    texts = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    with frames.noted(paths):
        lm_scoring.score(texts, F.lit(True), queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), rounds=1)
    left = [Path(p.removeprefix("file:")).exists() for p in paths]
    assert left == ["corpus" not in p for p in paths] and left.count(False) == 1

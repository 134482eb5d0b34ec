"""op9 against brute force, and the FM-index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6), st.integers(1, 9))
def test_backward_search_finds_all(codes, patterns, sample):
    codes = np.array([*codes, 0], np.int32)
    index = D.FMIndex(codes, 3, sample)
    width = max(map(len, patterns))
    rows = np.array([[0] * (width - len(p)) + p for p in patterns], np.int32)
    low, high = index.search(rows, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(codes) - len(p) + 1) if codes[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(rows, items, window=10):
    grams = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = {}
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out[k] = (len(w), len(hit), sorted(found))
    return out


def corpus():
    r = random.Random(9)
    v = [f"{c}{k}" for k in range(25) for c in "aÉ"]
    items = [(k, " ".join(r.choices(v, k=r.randrange(1, 40)))) for k in range(30)] + [(100, None), (101, "..."), (102, "x1 x2 x3"), (103, "X1, x2; x3"), (None, "x1 x2 x3")]
    rows = []
    for k in range(60):
        t = r.choices(v + ["zz", "yy"], k=r.randrange(0, 80))
        if r.random() < 0.5:
            at = r.randrange(len(t) + 1)
            t[at:at] = (r.choice(items)[1] or "").split()
        rows.append((k, r.choice([" ", ", ", "\n"]).join(t).upper() if r.random() < 0.3 else " ".join(t)))
    return rows + [(900, None), (901, ""), (902, "x1 x2 x3 x1 X2 x3"), (903, "x1 x2"), (904, "x3")], items


@pytest.mark.parametrize(("shard", "most"), [(8 << 20, 32 << 20), (200, 32 << 20), (500, 600)])
def test_op9_is_brute_force(spark, docs, monkeypatch, shard, most):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "ITEM_BYTES", most)
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in D.decontaminate(docs(rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()}
    assert got == brute(rows, items)


@pytest.mark.parametrize("most", [32 << 20, 600])
def test_spans_and_cleaned_texts(spark, docs, monkeypatch, most):
    monkeypatch.setattr(D, "ITEM_BYTES", most)
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    for x in D.decontaminate(docs(rows), bench, spans=True).collect():
        assert sum(s["last"] - s["first"] + 1 for s in x.spans) == x.n_hit == want[x.doc_id][1]
    clean = {x.doc_id: x for x in D.cleaned(docs(rows), bench).collect()}
    for k, t in rows:
        assert len(words(clean[k].text)) == want[k][0] - want[k][1]
        if not want[k][1]:
            assert clean[k].text == t
        assert clean[k].n_chars == len(clean[k].text or "")
    assert clean[902].text.strip() == ""


def test_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(x) for x in D.decontaminate(docs([(1, "a b")]), none).select("n_words", "n_hit", "n_items").collect()] == [(2, 0, 0)]
    assert D.decontaminate(docs([]), none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("most", [32 << 20, 600])
def test_every_repeated_row_has_its_answer(spark, docs, monkeypatch, most):
    monkeypatch.setattr(D, "ITEM_BYTES", most)
    rows, items = corpus()
    some = rows[:20]
    rows = [*some, *some[:7], some[0], (some[1][0], some[2][1]), (None, some[3][1]), (None, some[3][1]), (None, None), (None, ""), (901, ""), (901, None), (901, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(((k, *brute([(k, t)], items)[k]) for k, t in rows), key=repr)
    got = D.decontaminate(docs(rows), bench, spans=True).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got), key=repr) == want
    assert all(sum(s["last"] - s["first"] + 1 for s in x.spans) == x.n_hit for x in got)


def test_long_words_that_polynomials_confuse(spark, docs):
    x = [0]
    for _ in range(10):
        x += [1 - k for k in x]
    x, y = ("".join("ab"[k ^ flip] for k in x) for flip in (0, 1))
    got = {r.doc_id: r.n_hit for r in D.decontaminate(docs([(1, x), (2, y), (3, f"{y} {x}")]), spark.createDataFrame([(1, x)], "item_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_hashes_that_collide_are_told_apart_by_bytes(monkeypatch):
    """With a hash of the length alone, words are still found by their bytes and the vocabulary is made with another seed."""
    real = D.K.word_hashes
    monkeypatch.setattr(D.K, "word_hashes", lambda data, s, e, seed: real(data, s, e, seed) if seed > 500 else (e - s).astype(np.uint64))
    windows = D.Windows([(1, "abcdefghij1 abcdefghij2")], 1)
    assert windows.seed > 500 and len(windows.vocabulary) == 2
    windows = D.Windows([(1, "abcdefghij1")], 1)
    data = np.frombuffer(b"abcdefghij1 abcdefghij2", np.uint8)
    assert windows.encode(data, *D.words(data, np.array([0, len(data)]))).tolist() == [1, 0]


@pytest.mark.parametrize(("most", "window"), [(30, 3), (100, 10), (1, 4)])
def test_long_items_in_pieces_have_their_windows(monkeypatch, most, window):
    import pyarrow as pa

    monkeypatch.setattr(D, "PIECE_BYTES", most)
    r = random.Random(most)
    rows = [(k, None if k == 3 else r.choice(["  ", ", "]).join(r.choices(["ab", "É", "x" * 40, "c3"], k=r.randrange(0, 60)))) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["item_id", "text"])
    grams = lambda w: {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)}
    found = {k: set() for k, _ in rows}
    for out in D._pieces(iter([batch]), window):
        for k, t in zip(*(c.to_pylist() for c in out.columns), strict=True):
            found[k] |= grams(words(t))
    assert found == {k: grams(words(t)) for k, t in rows}

"""op11 against brute force, and the skipping of blocks against scoring everything."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(L.CAPITALS, L.SMALL)


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(rows, items, k):
    """Sorted (item, rank, score, id) with null ids last."""
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, length = len(docs), sum(len(w) for _, w in docs)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, w in docs:
            m, score = 100 - 50 + (50 * len(w) * n) // length, 0
            for t in ts & set(w):
                df = sum(t in x for _, x in docs)
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += weight * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, -s[0], s[3]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "ß1", "2024", "x" * 9, "y" * 300]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(k, r.choice([" ", ", ", "-", "\n"]).join(x.upper() if r.random() < 0.2 else x for x in r.choices(words, weights, k=r.randrange(1, 60)))) for k in range(n)]
    rows += [(3, rows[3][1]), (900, None), (901, ""), (902, "?! ..."), (903, "w1 " * 30_000), (None, "w3 w4 w5"), (None, rows[7][1])]
    items = [(k, " ".join(r.choices(words, k=r.randrange(1, 12)))) for k in range(12)] + [(50, None), (51, "--"), (52, "unheard of"), (0, "w59 w2"), (None, "w1 w40")]
    return rows, items


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_op11_is_brute_force(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(L, "ITEM_BYTES", block_bytes)
    rows, items = corpus(1)
    got = L.search(L.build(docs(rows).repartition(5)), spark.createDataFrame(items, "item_id bigint, text string"), 7).collect()
    assert sorted(((x.item_id, x.rank, x.score, x.doc_id) for x in got), key=repr) == brute(rows, items, 7)


def test_ids_of_any_type_and_empty_tables(spark):
    rows, items = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], [("i", "one")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    wanted = spark.createDataFrame(items, "item_id string, text string")
    got = L.search(L.build(table), wanted).orderBy("rank").collect()
    assert [(x.item_id, x.rank, x.doc_id) for x in got] == [("i", 1, "a"), ("i", 2, "b"), ("i", 3, None)]
    assert L.search(L.build(table.limit(0)), wanted).collect() == []
    assert L.search(L.build(table), wanted.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**34), max_size=50))
def test_packing_is_undone(values):
    data, ends = L.packed(np.array(values, np.int64))
    assert L.unpacked(data).tolist() == values
    assert len(ends) == len(values) and (not values or ends[-1] == len(data))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 6))
def test_blocks_are_skipped_without_loss(seed, block, k):
    """Shards with small blocks: the same documents as by brute force, and each skipped block's bound is below the k-th score."""
    old, L.BLOCK = L.BLOCK, block
    try:
        rows, items = corpus(seed, 40)
        rows = [(i, t) for i, t in rows if i is not None]
        n = [len(terms(t)) for _, t in rows]
        documents, total = sum(x > 0 for x in n), sum(n)
        queries = [[(t, L.term_weight(documents, sum(t in set(terms(x)) for _, x in rows))) for t in sorted(set(terms(q)))] for _, q in items[:5]]
        best = [L.Best(k) for _ in queries]
        for part in (rows[:25], rows[25:]):
            texts = [(t or "").encode() for _, t in part]
            batch = L.shard_rows(0, np.array([i for i, _ in part]), np.zeros(len(part), bool), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), documents, total)
            columns = batch.to_pydict()
            table = {columns["term"][j]: tuple(columns[c][j] for c in ("df", "lasts", "peaks", "ends", "posts")) for j in range(batch.num_rows)}
            for q, b in zip(queries, best, strict=True):
                shard = L.Shard(table)
                L.search_shard(shard, q, b)
                for t, w in q:
                    for at in range(len(shard.postings(t)[0])) if t in table else ():
                        assert int(shard.block(t, at)[1].max()) == shard.postings(t)[1][at]
        for (_, q), b in zip(items[:5], best, strict=True):
            assert [(int(s), int(i)) for s, i in zip(b.score, b.id, strict=True)] == [(x[2], x[3]) for x in sorted(brute(rows, [(0, q)], k), key=lambda x: x[1])]
    finally:
        L.BLOCK = old


def test_blocks_below_the_threshold_stay_compressed():
    texts = [b"rare common " + b"common " * (k % 3) if k in (5, 6) else b"common filler" + b" filler" * 40 for k in range(2_000)]
    batch = L.shard_rows(0, np.arange(2_000), np.zeros(2_000, bool), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 2_000, 80_000)
    c = batch.to_pydict()
    shard = L.Shard({c["term"][j]: tuple(c[x][j] for x in ("df", "lasts", "peaks", "ends", "posts")) for j in range(batch.num_rows)})
    best = L.Best(2)
    L.search_shard(shard, [("common", 1), ("rare", 7_000)], best)
    assert best.id.tolist() in ([5, 6], [6, 5])
    assert len(shard.postings("common")[0]) == 16 and 1 <= sum(t == "common" for t, _ in shard.open) <= L.FIRST

"""op8 against all pairs, the sketch against set theory, and components against a plain search."""

import random
import re

import numpy as np
import pytest

from foliomill.llm import components, neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randrange(3, 200))
        for _ in range(r.randrange(1, 12)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = [x.upper() for x in w]
            rows.append((k, r.choice([" ", "\n", " \t "]).join(w)))
            k += 1
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE "), (5005, "a b c d"), (5006, "a b c d e"), (5007, "É b"), (5008, "é b"), (5009, "w " * 20_000)]


@pytest.mark.parametrize("chunk", [128, 3])
def test_op8_is_all_pairs(docs, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rows = corpus(chunk)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_large_family_in_several_components(docs, spark, monkeypatch):
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(5000)]

    def edited(w, edits):
        w = list(w)
        for k in r.sample(range(0, len(w), 10), edits):
            w[k] = r.choice(vocabulary)
        return w

    base = r.choices(vocabulary, k=400)
    centres = [edited(base, 9) for _ in range(5)]  # pairwise about 0.63
    texts = [" ".join(edited(c, 1)) for c in centres for _ in range(r.randrange(2, 8))]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    seen = []
    unsettled = N.unsettled
    monkeypatch.setattr(N, "CHUNK", 3)
    monkeypatch.setattr(N, "unsettled", lambda *x: seen.append(unsettled(*x).count()) or unsettled(*x))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(docs(rows)).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c, _ in want.values()}) == 5
    assert seen == [len(rows)]


def test_unsettled_meets_every_open_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 4)
    family = {7: range(7, 67), 100: range(100, 130), 200: range(200, 230)}
    joined = {k: 7 if k < 50 else 50 if k < 55 else k for k in family[7]} | {k: 100 for k in family[100]} | {k: k for k in family[200]}
    members = spark.createDataFrame([(k, f, -(-len(v) // 4)) for f, v in family.items() for k in v], "node bigint, component bigint, chunks int")
    linked = spark.createDataFrame([x for x in joined.items() if x[0] != x[1]], "node bigint, component bigint")
    got = {x.node: x for x in N.unsettled(members, linked).collect()}
    assert set(got) == {*family[7], *family[200]}  # the family of 100 is one component
    for a in got:
        for b in got:
            if got[a].component == got[b].component and joined[a] != joined[b]:
                assert got[b].chunk in got[a].meets and got[a].chunk in got[b].meets
    # the 43 nodes of the largest component meet only the chunks of the 17 others
    assert {len(got[k].meets) for k in range(7, 50)} == {5}


def test_nulls_repeats_and_nothing(docs):
    got = sorted((tuple(x) for x in N.near_duplicates(docs([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b"), (3, None)])).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (3, 0, 3, True)], key=str)
    assert N.near_duplicates(docs([])).count() == 0


def made(r, n, shared, rest):
    common = r.integers(0, 2**63, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([common, r.integers(0, 2**63, rest, dtype=np.uint64)])) for _ in range(n)]


def test_sketches_merge_and_estimate():
    r = np.random.Generator(np.random.PCG64(5))
    a, b = made(r, 2, 300, 100)
    x, y, both = N.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(x, y) == both).all()
    assert abs((x == y).mean() - 0.6) < 0.15
    n = np.array([400.0])
    for shared, want in ((390, True), (330, True), (100, False), (0, False)):
        s = N.sketches(made(r, 2, shared, 400 - shared))
        assert N.likely(s[:1], s[1:], n, n)[0, 0] == want
    assert (N.band_values(x[None]) == N.band_values(x[None])).all() and N.BANDS == N.band_values(x[None]).shape[1]


def test_linked_is_a_search_of_each_value():
    r = np.random.Generator(np.random.PCG64(7))
    base = r.integers(0, 2**16, (12, N.REGISTERS), dtype=np.uint16)
    registers = base[r.integers(0, 12, 300)].copy()
    for x in registers:
        x[r.permutation(N.REGISTERS)[: r.integers(0, 90)]] += np.uint16(1)
    marks, value = N.marks_of(registers), np.sort(r.integers(0, 40, 300)).astype(np.uint64)
    node = np.arange(300)
    edges, gone = N.linked(value, node, marks, node)
    bits = np.bitwise_count(marks[:, None, :] ^ marks[None, :, :]).sum(2)
    near = (bits <= N.NEAR) & (value[:, None] == value[None, :])
    a, b = np.nonzero(near & ~np.eye(300, dtype=bool))
    assert {tuple(x) for x in np.stack(N.forest(a, b), 1).tolist()} == {tuple(x) for x in np.stack(N.forest(*edges), 1).tolist()}
    assert near[edges[0], edges[1]].all()
    # a row that isn't sent on has one within SAME bits that is
    assert gone.any() and all((~gone & (value == value[k]) & (bits[k] <= N.SAME)).any() for k in np.flatnonzero(gone))
    none = np.zeros(0, np.int64)
    assert N.linked(none.astype(np.uint64), none, marks[:0], none)[0].shape == (2, 0)


def test_marks_tell_like_from_unlike():
    r = np.random.Generator(np.random.PCG64(8))
    for shared, low, high in ((343, 0.999, 1), (185, 0, 0.05), (0, 0, 0.01)):  # of 400: similarities 0.75, 0.3 and 0
        m = [N.marks_of(N.sketches(made(r, 2, shared, 400 - shared))) for _ in range(300)]
        near = np.mean([np.bitwise_count(x[0] ^ x[1]).sum() <= N.NEAR for x in m])
        assert low <= near <= high


def test_unlike_texts_of_one_form_are_no_family(spark):
    r = np.random.Generator(np.random.PCG64(9))
    sets = made(r, 400, 180, 220)  # all pairs have a similarity of 0.29
    rows = [(k, x.tobytes()) for k, x in enumerate(N.sketches(sets))]
    classes = spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "node bigint, registers binary").repartition(5)
    found = components.connected_components(N.families(classes, 400), 400)
    assert (found.groupBy("component").count().agg({"count": "max"}).first()[0] or 0) < 200
    assert N.families(classes, 400).where("a = b").isEmpty()


def test_common_counts_in_blocks():
    r = np.random.Generator(np.random.PCG64(6))
    sets = [np.unique(r.integers(0, 90, r.integers(1, 60), dtype=np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (N.common_counts(sets) == want).all() and (N.common_counts(sets, columns=7) == want).all()


def test_components(spark):
    r = random.Random(3)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)]
    low = {x: x for p in e for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in e:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    got = components.connected_components(spark.createDataFrame(e, "a bigint, b bigint").repartition(9), 10)
    assert {x.node: x.component for x in got.collect()} == {k: v for k, v in low.items() if k != v}
    a, b = components.forest(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 3: 1, 9: 8}


def test_ids_of_other_types(docs, spark):
    rows = [(k, f"{'abcde'[k % 5]} one two three four five six seven eight nine ten eleven twelve thirteen") for k in range(12)] + [(20, None), (21, "x y")]
    want = sorted((f"d{x.doc_id:02d}", x.n_shingles, f"d{x.component_id:02d}", x.kept) for x in N.near_duplicates(docs(rows)).collect())
    named = spark.createDataFrame([(f"d{i:02d}", t) for i, t in rows] + [(None, "z")], "doc_id string, text string")
    got = N.near_duplicates(named).collect()
    assert sorted(tuple(x) for x in got if x.doc_id is not None) == want
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)]


def thue_morse(a, b, steps=10):
    """Words of 2 ** steps bytes that a polynomial modulo 2 ** 64 can't tell apart."""
    x = [0]
    for _ in range(steps):
        x += [1 - k for k in x]
    return "".join(a if k else b for k in x), "".join(b if k else a for k in x)


def test_long_words_that_polynomials_confuse(docs):
    x, y = thue_morse("a", "b")
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_duplicates(docs([(1, x), (2, y), (3, x + " "), (4, f"{x} {x} {x} {x} {x} {x}"), (5, f"{y} {y} {y} {y} {y} {y}")])).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}

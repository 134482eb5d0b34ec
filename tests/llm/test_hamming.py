"""op12: probing against all codes, and neighbours against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import hamming as H


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 5, 60, 700]), st.sampled_from([64, 24, 7]), st.integers(0, 30))
def test_probing_retrieves_every_code_within_the_radius_once(seed, n, bits, most):
    r = np.random.default_rng(seed)
    codes = r.integers(0, 2**bits, n, dtype=np.uint64)
    codes[: n // 3] = codes[0] ^ (np.uint64(1) << r.integers(0, bits, n // 3).astype(np.uint64))
    queries = codes[:: max(1, n // 10)]
    tables = H.Tables(codes, bits)
    m, seen = len(tables.width), {}
    far = np.bitwise_count(queries[:, None] ^ codes)
    most = min(most, bits)
    for step in range(most + 1):
        for q, x, d in tables.probe(queries, step % m, step // m):
            for pair in zip(q.tolist(), x.tolist(), d.tolist(), strict=True):
                assert pair[:2] not in seen and far[pair[:2]] == pair[2]
                seen[pair[:2]] = step
        assert {(i, j) for i, j in zip(*np.nonzero(far <= step), strict=True)} <= seen.keys()


def rows_of(seed, n, length):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, length))
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, length))
    x[10:20] = x[3]
    return x


def brute(rows, k, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and np.any(np.array(v, float) != 0)]
    out = {}
    for a, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            found = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), j is None, j if j is not None else 0) for b, (j, w) in enumerate(good) if a != b and len(v) == len(w)]
            out[i] = sorted((round(s, 10), m, j) for s, m, j in found)[:k]
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 4_000])
def test_op12_recall_and_exact_scores(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(H, "QUERY_BYTES", block_bytes)
    rows = [(i, v.tolist()) for i, v in enumerate(rows_of(1, 3_000, 32))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "vec_id as number", "vec_id as code", "vec_id as row", "1 as rank")
    got = H.search(H.build(df), H.F.col("number") % 50 == 0).collect()
    want, hit = brute(rows, 5), 0
    x = np.array([v for _, v in rows])
    for g in got:
        exact = x[g.query_id] @ x[g.vec_id] / np.sqrt((x[g.query_id] @ x[g.query_id]) * (x[g.vec_id] @ x[g.vec_id]))
        assert abs(g.score - exact) < 1e-12 and g.query_id != g.vec_id
        hit += g.vec_id in {j for _, _, j in want[g.query_id]}
    assert sorted(g.rank for g in got) == sorted(list(range(1, 6)) * 60)
    assert hit >= 0.95 * 300


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, [2.0, 4.0, 6.0]), (50, v), (50, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (100, [None, 1.0, 2.0]), (6, [float("nan"), 1.0, 2.0]), (150, [float("inf"), 1.0, 1.0])]
    rows += [(None, v), (7, [1e-300, 2e-300, 3e-300]), (8, [1e300, 2e300, -3e300]), (200, [1.0, 1.0]), (9, [1.0, 0.5]), (250, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = H.search(H.build(df), H.F.col("number") % 50 == 0, 20).collect()
    at = {}
    for g in got:
        at.setdefault(g.query_id, []).append((g.rank, round(g.score, 9), g.vec_id))
    assert sorted(at) == [0, 50, 200]  # 250 has no other vector of its length
    assert [x[2] for x in sorted(at[0])] == [1, 2, 7, 50, 50, None, 8][: len(at[0])] or sorted(x[1] for x in at[0])[1:] == [1.0] * 6
    assert len(at[0]) == 7 and len(at[50]) == 14 and at[200] == [(1, round(1.5 / np.sqrt(2 * 1.25), 9), 9)]
    assert {x[2] for x in at[50]} == {0, 1, 2, 7, 8, 50, None}
    assert H.search(H.build(df.limit(0)), H.F.col("number") % 50 == 0).collect() == []
    named = spark.createDataFrame([("b", v), ("a", v), ("c", [3.0, 2.0, 1.0])], "vec_id string, embedding array<float>")
    got = H.search(H.build(named), H.F.col("number") >= 0, 1).collect()
    assert {(g.query_id, g.vec_id) for g in got} == {("a", "b"), ("b", "a"), ("c", "a")}

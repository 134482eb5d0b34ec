"""op13 against plain loops in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import centroids as C


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [min((dist(v, c), n) for n, c in enumerate(at)) for _, v in kept]
        for n in range(len(at)) if step < rounds else ():
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == n]
            if mine:
                at[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [sum(d for d, c in near if c == n) for n in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def make(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(size=(5, 64))[r.integers(0, 5, n)] + 0.4 * r.normal(size=(n, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    return rows + [(2, rows[2][1]), (n, [0.0] * 64), (n + 1, None), (n + 2, [1.0] * 63), (n + 3, [None] + [1.0] * 63), (n + 4, [float("nan")] * 64), (n + 5, [float("inf")] + [0.0] * 63), (n + 6, []), (None, [0.5] * 64)]


@pytest.mark.parametrize("n", [300, 4])
def test_op13_is_brute_force(spark, n):
    rows = make(n, n)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as cluster", "2 as distance", "'x' as vector", "0 as label").repartition(3)
    got = sorted((tuple(x) for x in C.cluster(df).collect()), key=repr)
    assert got == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id bigint, embedding array<float>")
    assert C.cluster(df).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 4), st.sampled_from([2, 40, 100_000]))
def test_annulus_keeps_the_nearest_and_its_ties(seed, k, length, spread):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread, (60, length)), r.integers(-spread, spread, (k, length))
    c[-1] = c[0]
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    for before in (np.full(60, -1), r.integers(0, k, 60)):
        cluster, distance = C.nearest(x, c, before)
        assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_components_beyond_the_range_end_the_query(spark):
    df = spark.createDataFrame([(1, [3e6] + [0.0] * 63)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        C.cluster(df)

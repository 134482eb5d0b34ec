"""The automaton against plain search, for any cut of texts and patterns."""

import random

import numpy as np
import pytest

from foliomill.functions import automaton as A


@pytest.mark.parametrize("seed", range(60))
def test_minima_are_those_of_plain_search(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(A, "PIECE", r.choice([1, 3, 8, 256]))
    groups = r.randrange(1, 5)
    make = lambda n, m: sorted(((r.randrange(groups), "".join(r.choices("abé", k=r.randrange(0, m)))) for _ in range(n)), key=lambda x: x[0])
    patterns, texts = make(r.randrange(0, 12), 5), make(r.randrange(0, 12), 30)
    raw = [x.encode() for _, x in patterns + texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    group, n = np.array([g for g, _ in patterns + texts], np.int64), len(patterns)
    p, t = (at[:n], at[1 : n + 1], group[:n]), (at[n:-1], at[n + 1 :], group[n:])
    value = [r.randrange(100) for _ in texts]
    want = [min([v for v, (g, x) in zip(value, texts, strict=True) if g == k and s in x], default=A.NONE) if s else A.NONE for k, s in patterns]
    assert A.first_containing(data, p, t, np.array(value, np.int64), of_text=False).tolist() == want
    value = [r.randrange(100) for _ in patterns]
    want = [min([v for v, (k, s) in zip(value, patterns, strict=True) if g == k and s and s in x], default=A.NONE) for g, x in texts]
    assert A.first_containing(data, p, t, np.array(value, np.int64), of_text=True).tolist() == want


def test_packs():
    assert list(A.packs(np.array([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)] and list(A.packs(np.array([], int))) == []

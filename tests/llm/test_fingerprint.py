"""op1 against its definition, and the prefix hashes against plain comparison."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import fingerprint as P
from foliomill.llm import ranges as R


def points(x):
    return np.frombuffer(x.encode("utf-32-le"), np.uint32)


@settings(max_examples=100, deadline=None)
@given(st.text("abé", max_size=30), st.text("abé", max_size=30), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = P.PrefixHashes(points(a)), P.PrefixHashes(points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert x.extension(i, y, j) == n
    n = 0
    while n < min(i, j) and a[i - n - 1] == b[j - n - 1]:
        n += 1
    assert x.extension(i, y, j, back=True) == n
    k = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (x.span(i, i + k) == y.span(j, j + k)) == (a[i : i + k] == b[j : j + k])


def test_pieces_give_the_same_hashes(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé ", k=5_000))
    whole = P.fingerprint(text)
    monkeypatch.setattr(P, "PIECE", 700)
    monkeypatch.setattr(P, "_tables", [])
    parts = P.fingerprint(text)
    assert P.encoded(whole) == P.encoded(parts)


def test_likeness():
    f = P.fingerprint
    r = random.Random(2)
    long = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(400))
    other = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(400))
    assert P.likeness(f(long), f(long)) == 1 and P.likeness(f(""), f(None)) == 1 and P.likeness(f(""), f("a")) == 0
    half, none = P.likeness(f(long), f(P.edited(long, other))), P.likeness(f(long), f(other))
    assert 0.3 < half < 0.7 and none < 0.1 and P.likeness(f(long), f(long + " x")) > 0.9
    assert P.likeness(f("ab"), f("ac")) == 0.5
    again = P.decoded(P.encoded(f(long)))
    assert P.likeness(again, f(long)) == 1 and P.likeness(again, f(other)) == none


def brute_likeness(a, b):
    """The exact common ends, or the share of common spans if it is larger."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    x, y = P.fingerprint(a)[2], P.fingerprint(b)[2]
    least = sorted(set(x.tolist()) | set(y.tolist()))[: max(min(len(x), len(y)), 1) if max(len(x), len(y)) == P.MINIMA else None]
    spans = sum(v in x and v in y for v in least) / len(least)
    return max(spans, min(head + tail, n) / max(len(a), len(b)))


@pytest.mark.parametrize(("bucket", "splits"), [(40, 1024), (1 << 20, 1024), (100, 4), (30, 3)])
def test_op1_is_the_definition(docs, monkeypatch, bucket, splits):
    monkeypatch.setattr(P, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(R, "SPLITS", splits)
    monkeypatch.setattr(R, "GRAIN", 16)
    r = random.Random(3)
    rows = [(k * 7 % 101, "".join(r.choices("abé \n", k=r.randrange(0, 60)))) for k in range(60)] + [(500, None), (501, ""), (502, "x"), (503, "same"), (504, "same"), (900, "long " * 3000)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {x.doc_id: x for x in P.fingerprints(docs(rows)).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert g.fingerprint == P.encoded(P.fingerprint(t)) and g.edited_fingerprint == P.encoded(P.fingerprint(new))
        assert g.near_edited == pytest.approx(brute_likeness(t, new)) and g.near_next == pytest.approx(brute_likeness(t, after))
    assert got[503].fingerprint == got[504].fingerprint


def test_empty_single_and_repeated_rows(docs):
    assert P.fingerprints(docs([])).count() == 0
    (one,) = P.fingerprints(docs([(1, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert P.fingerprints(docs([(1, "a"), (1, "a"), (2, "b"), (None, "c")])).count() == 4


def test_ids_of_other_types(docs, spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_BYTES", 40)
    rows = [(k, "".join(random.Random(k).choices("ab ", k=30))) for k in range(40)]
    named = spark.createDataFrame([(f"d{i:03d}", t) for i, t in rows], "doc_id string, text string")
    want = {f"d{x.doc_id:03d}": (x.edited_sha256, x.near_next) for x in P.fingerprints(docs(rows)).collect()}
    assert {x.doc_id: (x.edited_sha256, x.near_next) for x in P.fingerprints(named).collect()} == want

"""op3 against brute force, and the enhanced suffix array against the definition of a maximal repeat."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import suffixes as S


def brute_repeats(texts, least):
    found = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                found.setdefault(t[i:j], []).append((k, i))
    out = []
    for x, at in found.items():
        right = {(k, i, "end") if i + len(x) == len(texts[k]) else texts[k][i + len(x)] for k, i in at}
        left = {(k, i, "start") if i == 0 else texts[k][i - 1] for k, i in at}
        if len(at) > 1 and len(right) > 1 and len(left) > 1:
            out.append((x, sorted(at)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=24).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=4), st.integers(2, 5))
def test_maximal_repeats_are_those_of_the_definition(texts, least):
    got = [g for g in S.repeat_groups(texts, least) if len(g[1]) > 1]
    assert got == brute_repeats(texts, least)


def brute(rows, least=S.LEAST):
    seen, out = set(), {}
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append((t or "").encode())
    for i in sorted(by_id, key=lambda x: (x is not None, x)):
        new = set()
        for b in by_id[i]:
            cut = bytearray(len(b))
            for p in range(len(b) - least + 1):
                g = b[p : p + least]
                new.add(g)
                if g in seen:
                    cut[p : p + least] = b"\1" * least
            kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
            spans = sum(1 for k in range(len(cut)) if cut[k] and not (k and cut[k - 1]))
            out.setdefault(i, []).append((len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return {i: sorted(v) for i, v in out.items()}


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randrange(1, 7))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=r.randrange(8, 40))) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = [r.choice([r.choice(passages), " ".join(r.choices(words, k=r.randrange(1, 30)))]) for _ in range(r.randrange(1, 5))]
        t = r.choice([" ", "\n", ""]).join(parts)
        if r.random() < 0.3 and rows:
            t = r.choice(rows)[1]
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(["", "X", "yy"]) + t[at + r.randrange(3) :]
        rows.append((k * 3, t))
    return rows + [(1, None), (2, ""), (4, "ab" * 400), (5, "ab" * 300), (7, "x" * 49), (8, "x" * 50), (10, "x" * 51), (11, "é" * 200), (500, passages[0] * 20)]


def answers(df):
    got = {}
    for x in df.collect():
        got.setdefault(x.doc_id, []).append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize(("block", "hot", "often", "piece", "group", "padded"), [(500, 512, 64, 1 << 18, 50_000, 1 << 24), (500, 1, 64, 1 << 18, 40, 2_000), (1 << 20, 512, 1, 300, 50_000, 1 << 24), (300, 3, 2, 1 << 18, 90, 5_000)])
def test_op3_is_brute_force(docs, monkeypatch, block, hot, often, piece, group, padded):
    for name, value in (("BLOCK_BYTES", block), ("HOT_BLOCKS", hot), ("HOT_SNIPPETS", often), ("PIECE", piece), ("GROUP", group), ("PADDED", padded)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(hot + often)
    out = S.without_repeats(docs(rows), text=True, carry=["lang", "score"])
    for x in out.collect():
        text = dict(rows)[x.doc_id]
        assert x.score == x.doc_id and x.lang == "en" and (x.kept_text is None) == (text is None)
        if text and text.isascii():
            assert hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256
    assert answers(out) == brute(rows)


@pytest.mark.parametrize("least", [20, 33, 77])
def test_other_lengths(docs, monkeypatch, least):
    monkeypatch.setattr(S, "BLOCK_BYTES", 600)
    rows = corpus(least)
    assert answers(S.without_repeats(docs(rows), least=least)) == brute(rows, least)


def test_without_the_suffix_array_nothing_is_removed():
    rows = corpus(3)
    text = [(t or "").encode() for _, t in rows]
    blank = S.Block(table_of(rows), 8)
    flags = np.ones(len(blank.key), np.uint8)
    part, *_ = blank.asked(flags)
    assert len(part) and not blank.covered(flags, {p: bytes(4 * (b - a)) for p, a, b in S.cuts(part)}).any()
    assert sum(map(len, text)) == len(blank.data)


@pytest.mark.parametrize("nothing", [False, True])
def test_without_intervals_nothing_is_removed(monkeypatch, nothing):
    """One block through all steps: with a scan that yields no interval not a byte goes, with the real one what has to."""
    if nothing:
        monkeypatch.setattr(S, "maximal_repeats", lambda *_: iter(()))
    rows = [r for r in corpus(4) if r[1]] + [(700, "copied text " * 9), (701, "copied text " * 9), (702, "copied text " * 9)]
    block = S.Block(table_of(rows), 8)
    flags = np.ones(len(block.key), np.uint8)
    part, place, length, low, others, *_ = block.asked(flags)
    found = {p: S.window_masks(block.data[S.K.aranges(place[a:b], length[a:b])], length[a:b], low[a:b], others[a:b].astype(np.uint8)).tobytes() for p, a, b in S.cuts(part)}
    covered = block.covered(flags, found)
    removed = [int(covered[a:b].sum()) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
    want = brute(rows)
    assert removed == [0 if nothing else want[i][0][1] for i, _ in rows] and any(v[0][1] for v in want.values())


def table_of(rows):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "number": pa.array([i for i, _ in rows], pa.int64())})


def test_occurrences_are_all_those_of_each_repeat(docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    rows = [r for r in corpus(9) if r[0] not in (4, 5, 10)]
    groups = {}
    for x in S.repeat_occurrences(docs(rows)).collect():
        groups.setdefault(bytes(x.repeat), set()).add((x.doc_id, x.first))
    texts = {i: (t or "").encode() for i, t in rows}
    assert groups
    for r, places in groups.items():
        assert places == {(i, p) for i, t in texts.items() for p in range(len(t) - len(r) + 1) if t[p : p + len(r)] == r} and len(places) > 1
    # every window that occurs twice is in one of them
    windows = {}
    for i, t in texts.items():
        for p in range(len(t) - S.LEAST + 1):
            windows.setdefault(t[p : p + S.LEAST], set()).add((i, p))
    held = {r[k : k + S.LEAST] for r in groups for k in range(len(r) - S.LEAST + 1)}
    assert held == {w for w, at in windows.items() if len(at) > 1}


def test_ids_of_other_types(docs, spark):
    rows = corpus(5)[:30]
    named = spark.createDataFrame([(f"d{i:05d}", t) for i, t in rows], "doc_id string, text string")
    assert answers(S.without_repeats(named)) == {f"d{i:05d}": v for i, v in brute(rows).items()}


def test_repeated_null_and_missing_rows(docs):
    long = " ".join(str(k) for k in range(60))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "y")]
    got = sorted(((x.doc_id, x.n_removed) for x in S.without_repeats(docs(rows)).collect()), key=str)
    assert got == sorted([(1, len(long)), (1, len(long)), (2, len(long)), (None, 0), (3, 0)], key=str)
    assert S.without_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        S.without_repeats(docs(rows), least=200)


def test_runs_cover_every_window_once():
    r = np.random.Generator(np.random.PCG64(1))
    texts = [bytes(r.integers(97, 100, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 400, 3, 1000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, first, last, _ = S.halves(data, offsets)
    windows = sorted(p for a, b in zip(first, last, strict=True) for p in range(a, b + 1))
    assert windows == [int(o) + k for o, t in zip(offsets, texts, strict=False) for k in range(len(t) - 49)]
    assert all(offsets[x] <= a and b + 50 <= offsets[x + 1] for x, a, b in zip(row, first, last, strict=True))

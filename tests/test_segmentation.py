"""Segmentation against a sequential model, and each quirk on its own."""

import random

import pytest

from pyspark.sql import functions as F

from foliomill.operators import matching as M
from foliomill.operators import scan
from foliomill.operators import segmentation as S

E = "book string, page int, seq int, top int, text_head string, text_inline string"
TOC = "book string, seq int, level int, heading string, page int"


def frames(spark, toc, pages, book="b"):
    t = spark.createDataFrame([(book, k, lv, h, p) for k, (lv, h, p) in enumerate(toc)], TOC)
    e = spark.createDataFrame([(book, p, k, top, x, y) for p, els in pages.items() for k, (top, x, y) in enumerate(els)], E)
    return t, e


def norm(x):
    return "".join(c for c in x if c.isalnum() or c in "_ ").strip().lower()


def same(text, heading):
    if text is None:
        return False
    if text.strip().lower().replace(" ", "") == heading.strip().lower().replace(" ", ""):
        return True
    t, h = norm(text), norm(heading)
    return h in t or (t != "" and t in h)


def sequential(toc, pages):
    """The procedure in order, one page and one heading after the other: [(level, heading, content)] and the unmatched headings."""
    out, open_, missed, k = [], None, [], 0
    for page, els in pages.items():
        here = []
        while k < len(toc) and toc[k][2] == page:
            here.append(toc[k])
            k += 1
        for level, heading, _ in here:
            hit = next((i for i, (_, a, b) in enumerate(els) if same(a, heading) or same(b, heading)), None)
            for _, a, b in els[:hit]:
                if open_ is not None:
                    open_[2].append(a or b)
            if hit is None:
                lines = {}
                for top, _, b in els:
                    lines.setdefault(top, []).append(b)
                texts = [" ".join(x for x in v if x).strip() for v in lines.values()]
                hit = next((i for i, t in enumerate(texts) if same(t, heading)), None)
                if open_ is not None:
                    open_[2].extend(texts[:hit])
            if hit is None:
                missed.append((page, heading))
            else:
                open_ = (level, heading, [])
                out.append(open_)
    return out, missed


WORDS = ["alpha", "beta", "gamma", "Chapter 1", "1", "delta epsilon", "Beta!", "zeta"]


def case(seed):
    r = random.Random(seed)
    pages = {p: [(r.randrange(3) * 10, r.choice([None, "", *WORDS]), r.choice(["", *WORDS])) for _ in range(r.randrange(1, 5))] for p in range(1, r.randrange(2, 6))}
    toc, p = [], 1
    for _ in range(r.randrange(1, 7)):
        p = max(1, p + r.choice([0, 0, 1, 1, 2, -1] if r.random() < 0.3 else [0, 1]))
        toc.append((r.randrange(1, 4), r.choice(WORDS), p))
    return toc, pages


def test_compat_is_the_sequential_procedure(spark):
    cases = {f"b{s}": case(s) for s in range(60)}
    toc = spark.createDataFrame([(b, k, *x) for b, (t, _) in cases.items() for k, x in enumerate(t)], TOC)
    els = spark.createDataFrame([(b, p, k, *x) for b, (_, pages) in cases.items() for p, e in pages.items() for k, x in enumerate(e)], E)
    got, missed = {}, {}
    for r in S.segment(toc, els).orderBy("book", "sec_seq").collect():
        got.setdefault(r.book, []).append((r.level, r.heading, r.content))
    for r in S.unmatched(toc, els).orderBy("book", "seq").collect():
        missed.setdefault(r.book, []).append((r.page, r.heading))
    for b, (t, pages) in cases.items():
        want, lost = sequential(t, pages)
        assert got.get(b, []) == ([(None, None, None)] + want if want else []), (b, t, pages)
        assert missed.get(b, []) == lost, (b, t, pages)


def brute_hits(toc, els, both_ways):
    out = {}
    for book, seq, _, heading, page in toc:
        h = norm(heading)
        for b, p, at, _, x, y in els:
            for t in (x, y):
                k = None if t is None else norm(t)
                if b == book and p == page and k is not None and ((t.strip().lower().replace(" ", "") == heading.strip().lower().replace(" ", "")) or h in k or (both_ways and k and k in h)):
                    out[book, seq] = min(at, out.get((book, seq), at))
    return out


@pytest.mark.parametrize(("rows", "both_ways"), [(50_000, True), (50_000, False), (3, True)])
def test_S4_matching_is_all_pairs(spark, monkeypatch, rows, both_ways):
    """The automaton against every pair of a heading and an element, also with pages that are cut into parts of three rows."""
    monkeypatch.setattr(M, "PAGE_ROWS", rows)
    r = random.Random(rows + both_ways)
    words = ["alpha", "al", "beta", "Chap ter 1", "chapter1", "1", "Ünï", "ünï code", "!", "", " ", "delta " * 90, "x" * 40_000]
    text = lambda: " ".join(r.choices(words, k=r.randrange(0, 4)))
    toc, els = [], []
    for book in "abc":
        for page in (1, 2, 3):
            toc += [(book, page * 100 + k, 1, text(), page) for k in range(r.randrange(0, 9))]
            els += [(book, page, k, 0, r.choice([None, text()]), text()) for k in range(r.randrange(0, 12))]
    t, e = spark.createDataFrame(toc, TOC), spark.createDataFrame(els, E).withColumnRenamed("seq", "el")
    got = {(x.book, x.seq): x.hit for x in M.first_hits(t, e, ["text_head", "text_inline"], "el", both_ways=both_ways).collect()}
    assert got == brute_hits(toc, els, both_ways)


@pytest.mark.parametrize("span", [1 << 16, 10, 1])
def test_a_scan_over_ranges_is_a_scan_over_the_book(spark, span):
    r = random.Random(2)
    rows = [(b, k * step, r.choice([None, 1, 2, 5])) for b, n, step in (("a", 80, 1), ("b", 9, 37), (None, 20, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "book string, seq int, v int").repartition(7)
    got = {(x.book, x.seq): (x.s, x.l) for x in scan.scanned(df, ("book",), ("seq",), sums={"s": F.col("v")}, lasts={"l": F.col("v")}, span=span).collect()}
    same = {(x.book, x.seq): (x.s, x.l) for x in scan.scanned(df, ("book",), ("seq",), sums={"s": F.col("v")}, lasts={"l": F.col("v")}, span=span, inclusive=True).collect()}
    number = {(x.book, x.seq): x.n for x in scan.numbered(df, ("book",), ("seq",), "n", 1, span=span).collect()}
    for book in {b for b, _, _ in rows}:
        s, last = 0, None
        for n, (seq, v) in enumerate(sorted(((q, v) for b, q, v in rows if b == book), key=lambda x: x[0]), 1):
            assert got[book, seq] == (s, last) and number[book, seq] == n
            s, last = s + (v or 0), last if v is None else v
            assert same[book, seq] == (s, last)


def test_segments_are_the_same_in_many_ranges(spark, monkeypatch):
    """Books of eight ranges of pages and entries give the rows of books in one range, in both modes."""
    r = random.Random(11)
    toc, els = [], []
    for book in ("x", "y"):
        seq = 0
        for page in range(1, 41):
            els += [(book, page, k, k, r.choice([None, "", *WORDS]), r.choice(["", *WORDS])) for k in range(3)]
            for _ in range(r.randrange(0, 3)):
                toc.append((book, seq, r.randrange(1, 4), r.choice([*WORDS, "nowhere at all"]), page))
                seq += 1
    t, e = spark.createDataFrame(toc, TOC), spark.createDataFrame(els, E)
    want = [sorted(map(tuple, S.segment(t, e, mode=m).collect()), key=repr) for m in ("compat", "full")]
    monkeypatch.setattr(scan, "SPAN", 5)
    assert want == [sorted(map(tuple, S.segment(t, e, mode=m).collect()), key=repr) for m in ("compat", "full")]


def test_S1_null_page_rejects_the_book(spark):
    t, e = frames(spark, [(1, "alpha", 1), (1, "beta", None)], {1: [(0, "alpha", "")]})
    assert [tuple(r) for r in S.rejected_books(t).collect()] == [("b", "NULL_PAGE")] and S.segment(t, e).count() == 0


def test_S2_stall(spark):
    t, e = frames(spark, [(1, "a", 1), (1, "b", 5), (1, "c", 3), (1, "d", 6)], {p: [(0, "x", "")] for p in range(1, 7)})
    assert [r.seq for r in S.reachable(t, e).orderBy("seq").collect()] == [0, 1]
    t, e = frames(spark, [(1, "a", 1), (1, "b", 9), (1, "c", 2)], {1: [(0, "x", "")], 2: [(0, "x", "")]})
    assert [r.seq for r in S.reachable(t, e).collect()] == [0]


def test_S6_line_tier(spark):
    t, e = frames(spark, [(1, "deep water", 1)], {1: [(5, None, "deep"), (5, None, "water"), (9, "rest", "")]})
    found = S.hits(t, e).first()
    assert found.hit == 0  # a fragment of the heading is enough for the element tier in compat
    found = S.hits(t, e, both_ways=False).first()
    assert found.hit is None and found.line_hit == 0


@pytest.mark.parametrize(("mode", "want"), [("compat", []), ("full", ["h1 body", "lost", "tail"])])
def test_S8_page_without_heading(spark, mode, want):
    t, e = frames(spark, [(1, "head one", 1)], {1: [(0, "head one", ""), (1, "h1 body", "")], 2: [(0, "lost", ""), (1, "tail", "")]})
    assert S.segment(t, e, mode=mode).where("heading is not null").first().content == want


def test_S8_two_headings_on_a_page(spark):
    t, e = frames(spark, [(1, "head one", 1), (2, "other two", 1)], {1: [(0, "head one", ""), (1, "body", ""), (2, "other two", "")]})
    first, second = S.segment(t, e).where("heading is not null").orderBy("sec_seq").collect()
    assert first.content == ["head one", "body"] and second.content == []
    first, second = S.segment(t, e, mode="full").orderBy("sec_seq").collect()
    assert first.content == ["body"]


def test_S9_strict_unopened(spark):
    t, e = frames(spark, [(1, "nowhere", 1), (1, "beta", 1)], {1: [(0, "text", "text"), (1, "beta", "")]})
    assert S.segment(t, e).count() == 2 and S.segment(t, e, strict_unopened=True).count() == 0


def test_S10_compat_log(spark):
    t, e = frames(spark, [(1, "alpha", 1), (1, "nowhere", 1)], {1: [(0, "alpha", "")]})
    assert [r.heading for r in S.unmatched(t, e).collect()] == ["nowhere"]
    assert sorted(r.heading for r in S.unmatched(t, e, mode="compat").collect()) == ["alpha", "nowhere"]


def test_S11_no_match_no_segments(spark):
    t, e = frames(spark, [(1, "nowhere", 1)], {1: [(0, "text", "")]})
    assert S.segment(t, e).count() == 0


def test_only_pages_with_entries_are_matched(spark):
    """Units of other pages are left out before their keys are made."""
    entries = spark.createDataFrame([("b", 1, 0, "One"), ("b", 3, 1, "Two"), (None, 2, 2, "x")], "book string, page int, seq int, heading string")
    units = spark.createDataFrame([("b", p, k, t) for p in (1, 2, 3) for k, t in enumerate(["zzz", "one", "two"])] + [(None, 2, 0, "x")], "book string, page int, el int, text string")
    found = M.first_hits(entries, units, ["text"], "el")
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("b", 0, 1), ("b", 1, 2)]

"""Candidates, trees, metrics, references and reports; goldens where outline files are given."""

import os
import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.operators import candidates as C
from foliomill.operators import metrics as M
from foliomill.operators import references as R
from foliomill.operators import reports, trees
from foliomill.sources import outlines

# ---- candidates ------------------------------------------------------------------------------------------------


def test_D1_D2_D3(spark):
    rows = spark.createDataFrame([("b", k, f) for k, f in enumerate(["x"] * 10 + ["z"] * 6 + ["y"] * 5 + ["w"] * 6)], "book string, seq int, font_id string")
    h = C.histogram(rows, "font_id").orderBy("rank")
    assert [(r.font_id, r.n) for r in h.collect()] == [("x", 10), ("z", 6), ("w", 6), ("y", 5)]
    assert {r.font_id for r in C.baseline(h).collect()} == {"x", "z", "w"}


def test_D4_bounds(spark):
    rows = spark.createDataFrame([("b", k, "r" if k < 220 else "c") for k in range(441)], "book string, seq int, font_id string")
    assert {r.font_id for r in C.rare(rows).select("font_id").distinct().collect()} == {"r"}


def test_D5(spark):
    books = spark.createDataFrame([("a",), ("b",)], "book string")
    assert [r.book for r in C.without_candidates(books, books.where("book = 'a'")).collect()] == ["b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.integers(0, 20))
def test_D6_is_the_fold(tokens, limit):
    batch = used = 0
    want = []
    for t in tokens:
        over = used + t > limit
        batch, used = batch + over, (0 if over else used) + t
        want.append(batch)
    assert C.greedy_batches(np.array(tokens, np.int64), limit).tolist() == want


@pytest.mark.parametrize(("tokens", "limit", "want"), [([3, 4, 5, 9], 8, [0, 0, 1, 2]), ([], 8, []), ([9, 1], 8, [1, 2]), ([8, 1], 8, [0, 1])])
def test_D6_batches(spark, tokens, limit, want):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    assert df.select(C.batch_numbers(F.col("t"), limit)).first()[0] == want


def test_D7_last_per_level(spark):
    rows = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("b", 2, 2), ("b", 3, None)], "book string, seq int, level int")
    assert [(r.seq, r.level) for r in C.last_per_level(rows).orderBy("recency").collect()] == [(3, 1), (2, 2)]


def test_D8_refiner_sees_its_own_context(spark):
    rows = spark.createDataFrame([("b", k, 1 + k % 2, f"t{k}", k, 3) for k in range(6)], "book string, seq int, level int, heading string, page int, tokens int")

    def tagged(batch, context):
        return [{"level": r["level"], "heading": r["heading"] + "|" + ",".join(c["heading"].split("|")[0] for c in context), "page": r["page"]} for r in batch]

    got = [r.heading for r in C.refine(rows, tagged, limit=8).orderBy("seq").collect()]
    assert got[0] == "t0|" and got[2] == "t2|t1,t0" and got[4] == "t4|t3,t2"
    assert C.refine(rows).count() == 6


def test_D9_D10(spark):
    raw = spark.createDataFrame([("b", '"1","Alpha, ""x""","4"\n"2","Beta","iv"\nnot csv\n"1","a","2","3"')], "book string, raw string")
    good, bad = C.parsed_response(raw)
    assert sorted(((r.level, r.heading, r.page) for r in good.collect()), key=str) == [("1", 'Alpha, "x"', 4), ("2", "Beta", None)]
    assert bad.count() == 2 and C.valid(good).count() == 1


def test_D11_style(spark):
    rows = spark.createDataFrame([("b", k, "t", 9.0, False, False) for k in range(400)] + [("b", 400, "h", 14.0, False, False), ("b", 401, "i", 11.0, True, False)], "book string, seq int, font_id string, font_size double, bold boolean, italic boolean")
    assert [(r.seq, r.level) for r in C.by_style(rows).orderBy("seq").collect()] == [(400, 1), (401, 2)]


# ---- trees --------------------------------------------------------------------------------------------------------


def slow_distance(a, b):
    """The recursive definition over forests of (label, children)."""
    from functools import cache

    def grow(items):
        labels, parent = trees.outline_tree(items)
        kids = [[] for _ in labels]
        for k, p in enumerate(parent):
            if p >= 0:
                kids[p].append(k)

        def build(k):
            return (labels[k], tuple(build(c) for c in kids[k]))

        return (build(0),)

    cost = lambda t: int(t[0] != "")

    @cache
    def d(f, g):
        if not f and not g:
            return 0
        if not f:
            return d(f, g[:-1] + g[-1][1]) + cost(g[-1])
        if not g:
            return d(f[:-1] + f[-1][1], g) + cost(f[-1])
        s, t = f[-1], g[-1]
        return min(d(f[:-1] + s[1], g) + cost(s), d(f, g[:-1] + t[1]) + cost(t), d(f[:-1], g[:-1]) + d(s[1], t[1]) + (s[0] != t[0]))

    return d(grow(a), grow(b))


outline = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["a", "b", "c", ""])), max_size=7)


@settings(max_examples=150, deadline=None)
@given(outline, outline)
def test_E5_is_the_definition(a, b):
    got = trees.tree_edit_distance(a, b)
    assert got == slow_distance(a, b) == trees.tree_edit_distance(b, a)
    assert got <= len(a) + len(b) and trees.tree_edit_distance(a, a) == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.integers(2, 9))
def test_E5_of_larger_trees_is_symmetric_and_mirrored(seed, n, depth):
    r = random.Random(seed)
    a, b = ([(r.randrange(1, depth), r.choice(["a", "b", ""])) for _ in range(n)] for _ in range(2))
    got = trees.tree_edit_distance(a, b)
    assert got == trees.tree_edit_distance(b, a) and trees.tree_edit_distance(a, a) == 0
    assert abs(sum(x != "" for _, x in a) - sum(x != "" for _, x in b)) <= got <= n + n

def test_tree_edit_distance_holds_no_table_of_both_outlines():
    rng = random.Random(3)
    a, b = ([(rng.randint(1, 3), str(rng.randint(0, 300))) for _ in range(n)] for n in (1_500, 2_500))
    tracemalloc.start()
    got = trees.tree_edit_distance(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 < 4 * len(a) * len(b), peak
    assert got == trees.tree_edit_distance(b, a)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["a", "b", ""])), max_size=7), st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["a", "b", "root"])), max_size=7))
def test_trees_that_are_not_kept_give_the_same_distance(a, b):
    a, b = a + a, b + b
    want, kept = trees.tree_edit_distance(a, b), trees.KEPT_BYTES
    trees.KEPT_BYTES = 0
    try:
        assert trees.tree_edit_distance(a, b) == want
    finally:
        trees.KEPT_BYTES = kept


@settings(max_examples=200, deadline=None)
@given(*[st.lists(st.sampled_from(["a", "b", "c", "root", ""]), max_size=12)] * 2)
def test_outlines_of_one_level_are_sequences(a, b):
    wide = [[(1, x) for x in side if x] for side in (a, b)]
    assert trees.tree_edit_distance([(1, x) for x in a], [(1, x) for x in b]) == slow_distance(*wide)


def test_long_outlines_of_one_level():
    a, b = [(1, str(k % 977)) for k in range(20_000)], [(1, str(k % 977)) for k in range(3, 20_000)]
    began = time.perf_counter()
    tracemalloc.start()
    assert trees.tree_edit_distance(a, b) == 3
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and time.perf_counter() - began < 20  # a table of both has 1.6 GB



@pytest.mark.parametrize("span", [1 << 16, 7, 1])
def test_E1_parents_across_ranges(spark, span):
    """A book in eight and more ranges gives the rows of a book in one."""
    r = random.Random(5)
    rows = [(book, k, r.choice(levels)) for book, levels in (("a", [1, 2, 3]), ("b", [5, 4, 3, 2, 1, 1_000_000]), ("c", [2, 2, 3]), (None, [1, 2])) for k in range(60)] + [("a", 60, None)]
    want = {}
    for book, k, level in rows:
        above = [s for b, s, lv in rows if b == book and s < k and lv is not None and level is not None and lv < level]
        want[book, k] = max(above, default=None)
    df = spark.createDataFrame(rows, "book string, seq int, level int").repartition(5)
    assert {(x.book, x.seq): x.parent for x in trees.parents(df, span=span).collect()} == want


def test_E1_E2_E3(spark):
    rows = spark.createDataFrame([("skip", 0, 1), ("skip", 1, 3), ("skip", 2, 1), ("low", 0, 2), ("low", 1, 2), ("ok", 0, 1), ("ok", 1, 2), ("ok", 2, 2), ("ok", 3, 1)], "book string, seq int, level int")
    assert {r.book: r.skips for r in trees.skips(rows).collect()} == {"skip": 1, "low": 1, "ok": 0}
    assert [r.parent for r in trees.parents(rows).where("book = 'ok'").orderBy("seq").collect()] == [None, 0, 0, None]
    assert trees.depth(rows, compat_plus_one=True).where("book = 'ok'").first().depth == 3
    assert trees.one_based(rows).agg(F.min("level")).first()[0] == 2
    named = rows.withColumn("heading", F.concat("book", "seq"))
    assert {r.book: r.etd for r in trees.edit_distances(named, named).collect()} == {"skip": None, "low": None, "ok": 0.0}
    assert trees.edit_distances(named, named, mode="full").where("etd <> 0").count() == 0


# ---- metrics --------------------------------------------------------------------------------------------------


def headings(spark, rows):
    return spark.createDataFrame(rows, "book string, heading string")


def test_F1_F2_F3(spark):
    got = M.precision_recall(headings(spark, [("b", "A"), ("b", "A"), ("b", "B"), ("t", "Alpha"), ("t", "x"), ("other", "z")]), headings(spark, [("b", "A"), ("b", "C"), ("t", "Alpho"), ("t", "Alphoo"), ("none", "q")]))
    rows = {r.book: r for r in got.collect()}
    assert (rows["b"].precision, rows["b"].recall) == (2 / 3, 1 / 2)
    assert (rows["t"].precision, rows["t"].tolerant_precision, rows["t"].tolerant_recall) == (0.0, 0.5, 0.5)
    assert (rows["none"].n_system, rows["none"].precision, rows["none"].recall) == (0, 0.0, 0.0) and set(rows) == {"b", "t", "none"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab é", max_size=4), min_size=1, max_size=6), st.lists(st.text("ab é", max_size=4), min_size=1, max_size=6))
def test_F3_is_all_pairs(spark, a, b):
    def near(x, y):
        if x == y:
            return True
        if abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) <= 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    row = M.precision_recall(headings(spark, [("b", x) for x in a]), headings(spark, [("b", x) for x in b])).first()
    assert row.tolerant_precision == pytest.approx(np.mean([any(near(x, y) for y in b) for x in a]))
    assert row.tolerant_recall == pytest.approx(np.mean([any(near(x, y) for x in a) for y in b]))


def bounds(spark, *contents):
    rows = [(f"b{i}", 0, k, t) for i, c in enumerate(contents) for k, t in enumerate(c)]
    return {r.book: (r.total, r.positions) for r in M.boundaries(spark.createDataFrame(rows, "book string, sec_seq int, pos int, text string")).collect()}


def test_F3_long_headings(spark):
    r = random.Random(3)
    truth, system, want = [], [], []
    for n in (62, 63, 64, 65, 66, 67, 90, 300):
        for _ in range(6):
            x = "".join(r.choices("abcdé", k=n))
            i, kind = r.randrange(n), r.randrange(5)
            y = {0: x, 1: x[:i] + x[i + 1 :], 2: x[:i] + "z" + x[i:], 3: x[:i] + "z" + x[i + 1 :], 4: "zz" + x[:i] + x[i + 1 :]}[kind]
            truth.append(("b", x))
            system.append(("b", y))
            want.append(kind < 4)
    row = M.precision_recall(headings(spark, system), headings(spark, truth)).first()
    assert row.tolerant_precision == pytest.approx(np.mean(want)) == row.tolerant_recall
    keys = spark.createDataFrame([("x" * 100_000,)], "h string").select(F.size(M.near_keys(F.col("h")))).first()[0]
    assert keys <= 6


def test_F4_boundaries(spark):
    got = bounds(spark, ["a b", "c"], [None, "ab"], ["abc"])
    assert got["b0"] == (4, [2]) and got["b1"] == (3, [0]) and got["b2"] == (3, [])


def plain_scores(a, b, k):
    pk = wd = n = 0
    for i in range(len(a) - k + 1):
        x, y = sum(a[i : i + k]), sum(b[i : i + k])
        pk += (x > 0) != (y > 0)
        wd += x != y
        n += 1
    return pk / n, wd / n


def test_F8_F9_sweep(spark):
    r = random.Random(8)
    cases = [([r.random() < d for _ in range(n)], [r.random() < d for _ in range(n)], k) for n in range(1, 41) for d in (0.05, 0.4) for k in (1, 3, r.randrange(1, 45))]
    rows = [(c, len(a), [i for i, x in enumerate(a) if x], [i for i, x in enumerate(b) if x], k) for c, (a, b, k) in enumerate(cases)]
    rows.append((len(cases), 10**15, [5, 10**14], [7], 1_000))  # places aren't made
    df = spark.createDataFrame(rows, "c int, total bigint, a array<bigint>, b array<bigint>, k int")
    pk, wd = M.window_scores(*(F.col(x) for x in ("total", "a", "b", "k")))
    for g in df.select("c", pk.alias("pk"), wd.alias("wd")).collect():
        if g.c < len(cases):
            a, b, k = cases[g.c]
            assert (g.pk, g.wd) == ((None, None) if k > len(a) else (pytest.approx(plain_scores(a, b, k)[0]), pytest.approx(plain_scores(a, b, k)[1])))
        else:
            assert 0 < g.pk <= g.wd < 1e-11


def test_F5_F6_F7(spark):
    s = "book string, total bigint, positions array<bigint>"
    a, b = spark.createDataFrame([("x", 10, [4]), ("none", 8, [])], s), spark.createDataFrame([("x", 12, [4, 8]), ("none", 8, [3])], s)
    rows = {r.book: r for r in M.segmentation_scores(a, b).collect()}
    assert (rows["x"].total, rows["x"].k) == (12, 9) and rows["none"].k == 5
    items = spark.createDataFrame([("x", [(0, "H", "ab"), (1, None, None)])], "book string, items array<struct<level:int,heading:string,content:string>>")
    assert [r.text for r in M.layout_units(items).orderBy("sec_seq").collect()] == ["Hab", ""]
    sections = spark.createDataFrame([("x", 0, None), ("x", 1, ["a", None])], "book string, sec_seq int, content array<string>")
    assert M.section_units(sections).count() == 2


# ---- references, reports ----------------------------------------------------------------------------------


def test_B20_references(spark):
    refs = spark.createDataFrame([("b", "a", "objref", "c", None), ("b", "c", "list", "d", None), ("b", "d", "dict", None, 7), ("b", "l1", "named", "l2", None), ("b", "l2", "named", "l1", None), ("b", "u", "odd", "d", None), ("b", "m", "dict", "gone", None)], "book string, ref string, kind string, next_ref string, page int")
    assert {r.ref: r.page for r in R.resolve(refs).collect()} == {"a": 7, "c": 7, "d": 7, "l1": None, "l2": None, "u": None, "m": None}
    toc = spark.createDataFrame([("b", 0, None, "", "a")], "book string, seq int, dest string, action string, element string")
    assert R.entry_page(toc, refs).first().page == 7
    assert [r.page for r in R.page_numbers(spark.createDataFrame([("b", 5), ("b", 9)], "book string, seq int")).orderBy("seq").collect()] == [1, 2]


def test_F11_to_F15(spark):
    rows = spark.createDataFrame([("a", "s", "p", v, d) for v, d in ((1.0, 2), (3.0, 2), (None, 2), (5.0, 3))], "book string, system string, metric string, value double, gt_depth int")
    got = {r.gt_depth: r for r in reports.by_depth(rows).collect()}
    assert (got[2].n, got[2].median, got[None].n, got[None].most) == (2, 2.0, 3, 5.0)
    assert {r.gt_depth: r.median for r in reports.by_depth(rows, missing=0.0).collect()}[2] == 1.0
    limits = reports.axis_limits(rows).first()
    assert (limits.low, limits.high) == (pytest.approx(0.8), pytest.approx(5.2))
    groups = spark.createDataFrame([("a", "G")], "book string, publisher_group string")
    more = rows.unionAll(spark.createDataFrame([("zz", "s", "p", 1.0, 2)], rows.schema))
    assert {(r.book, r.marker) for r in reports.with_group(more, groups).collect()} == {("a", 1), ("zz", 0)}
    assert reports.pivoted(rows.where("gt_depth = 3"), ["p"]).first().p == 5.0


def test_F11_quantiles_of_many_values(spark):
    r = np.random.default_rng(4)
    sides = {"even": r.integers(0, 7, 500).astype(float), "skew": np.concatenate([np.zeros(700), r.normal(size=300) * 1e6]), "one": np.array([3.5])}
    rows = [(k, float(x)) for k, v in sides.items() for x in v] + [("one", None), ("none", None), (None, 2.0)]
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {x.g: x for x in reports.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ("g",), "v", at).collect()}
    for k, v in sides.items():
        assert got[k].n == len(v) and [got[k][f"q{i}"] for i in range(len(at))] == pytest.approx(np.quantile(v, at).tolist()) and got[k]["mean"] == pytest.approx(v.mean())
    assert (got["none"].n, got["none"].q3, got["none"]["mean"]) == (0, None, None) and got[None].q0 == 2.0


# ---- goldens ----------------------------------------------------------------------------------------------------

TRUTH, SYSTEM = (Path(os.environ.get(x, "/nowhere")) for x in ("OUTLINE_TRUTH", "OUTLINE_SYSTEM"))
needs_data = pytest.mark.skipif(not (TRUTH.is_dir() and SYSTEM.is_dir()), reason="OUTLINE_TRUTH and OUTLINE_SYSTEM name no folders")


@pytest.fixture(scope="module")
def sides(spark):
    gt = outlines.read_naive(spark, str(TRUTH), "gt").cache()
    llm = outlines.read_naive(spark, str(SYSTEM), "llm", prefix=7).cache()
    return gt, llm


@needs_data
def test_golden_precision_recall(sides):
    gt, llm = (x.withColumnRenamed("heading_naive", "heading") for x in sides)
    rows = M.precision_recall(llm, gt).collect()
    mean = lambda c: round(sum(r[c] for r in rows) / len(rows), 4)
    assert len(rows) == 49
    assert (mean("precision"), mean("tolerant_precision"), mean("recall"), mean("tolerant_recall")) == (0.2538, 0.2787, 0.3346, 0.3557)
    one = next(r for r in rows if r.n_truth == 160 and r.n_system == 246)
    assert (round(one.precision, 6), one.recall) == (0.674797, 0.9875)


@needs_data
def test_golden_facts(spark, sides):
    gt, llm = sides
    assert gt.count() == 9_812
    assert {r.depth: r.n for r in trees.depth(gt).groupBy("depth").agg(F.count("*").alias("n")).collect()} == {2: 2, 3: 6, 4: 8, 5: 14, 6: 11, 7: 8}
    assert trees.skips(gt).where("skips > 0").count() == 0 and trees.skips(llm).where("skips > 0").count() == 18
    strict, rejects = outlines.read_strict(spark, str(TRUTH), "gt")
    assert strict.count() == 9_786 and rejects.count() == 26


@needs_data
def test_golden_tree_edit_distance(sides):
    gt, llm = (x.withColumnRenamed("heading_naive", "heading") for x in sides)
    found = {r.book: r.etd for r in trees.edit_distances(llm, gt).where("etd is not null").collect()}
    assert len(found) == 26 and round(sum(found.values()) / 26, 2) == 232.12
    assert 523 in found.values()


def test_E4_E7_F10_F12(spark):
    toc = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 2, "y"), ("b", 0, 1, "z")], "book string, seq int, level int, heading string")
    assert {r.depth: (r.n, r.least) for r in trees.books_by_depth(toc).collect()} == {2: (1, "a"), 1: (1, "b")}
    assert {(r.book, r.level): (r.n, r.first) for r in trees.headings_by_level(toc).collect()}[("a", 2)] == (1, "y")
    scores = spark.createDataFrame([("a", "s", "m", 1.0), ("b", "s", "m", 3.0), ("c", "s", "m", 9.0)], "book string, system string, metric string, value double")
    assert {r.gt_depth: r.n for r in reports.rebucketed(scores, trees.depth(toc)).collect()} == {2: 1, 1: 1, None: 2}
    b = spark.createDataFrame([("a", 9, [3]), ("b", 9, [3])], "book string, total bigint, positions array<bigint>")
    assert [r.book for r in M.segmentation_scores(b, b, exclude=["a"]).collect()] == ["b"]

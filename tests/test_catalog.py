"""Registered queries against brute force on small tables that the given ones don't hold."""

import pytest

import __spark_entry__ as entry
from foliomill.operators import matching
from foliomill.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    def make(docs=(), benchmark=()):
        spark.createDataFrame(list(docs), "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def oracle(name, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def rows(name, spark, sf_dir):
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()), key=repr)


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, last = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
    return line[-1]


def test_tolerant_scores_of_all_headings(spark, tables):
    truth, system = ["Über", "Maß – Zahl", "été", "Ende", "naïve", "ab"], ["Uber", "Maß — Zahl", "ete", "Ende", "naiv", "ba", "€€"]
    sf_dir = tables([(2, "\n".join(truth), "de", "s"), (1, "\n".join(system), "de", "s"), (4, "é", "fr", "s"), (3, "éé\nxyz", "fr", "s")])
    want = []
    for lang, t, s in (("de", truth, system), ("fr", ["é"], ["éé", "xyz"])):
        near = lambda x, side: any(distance(x, y) <= 1 for y in side)
        want.append((lang, round(sum(near(x, t) for x in s) / len(s), 9), round(sum(near(x, s) for x in t) / len(t), 9)))
    got = rows("tolerant_precision_recall_all", spark, sf_dir)
    assert got == want == [(a, float(b), float(c)) for a, b, c in oracle("tolerant_precision_recall_all", sf_dir)]


def test_parsing_of_headings_with_backslash_and_quote(spark, tables):
    lines = ["a\\", "\\", 'say "x"', '"', '\\"', 'a\\",b', "plain", '"all"', "a, b\\"]
    sf_dir = tables([(1, "\n".join(lines), "en", "s")])
    want = [("s", k, len(h) % 3 + 1, h, 1) for k, h in enumerate(lines)]
    assert rows("outline_parse_strict_all", spark, sf_dir) == want == oracle("outline_parse_strict_all", sf_dir)
    want = [(b, k, str(level), h, p) for b, k, level, h, p in want]
    assert rows("response_validate_all", spark, sf_dir) == want == oracle("response_validate_all", sf_dir)


@pytest.mark.parametrize("most", [4 << 20, 300])
def test_items_of_any_number_of_words(spark, tables, monkeypatch, most):
    monkeypatch.setattr(matching, "ITEM_BYTES", most)
    docs = [(1, "one two three four five six"), (2, "someone two three fourteen"), (3, ""), (4, None), (5, "x"), (5, "two  three"), (None, "one two three four fives")]
    texts = ["", "...", None, "two", "one two", "one two three", "one two three four", "one two three four five", "e two three four five s", "two three", "two  three", "One, two!", "zzz"]
    sf_dir = tables([(k, t, "en", "s") for k, t in docs], [*enumerate(texts), (None, "ne two three four fiv")])
    keys = [(k, "".join(c for c in t or "" if c.isalnum() or c == " ").strip().lower()) for k, t in [*enumerate(texts), (None, "ne two three four fiv")] if t is not None]
    want = sorted(((d, k) for d, t in docs if t is not None for k, h in keys if h in t), key=repr)
    assert rows("heading_contains_match", spark, sf_dir) == want == oracle("heading_contains_match", sf_dir)


def test_books_with_one_matched_heading_are_accepted(spark, tables):
    sf_dir = tables([(1, "one heading\n" + "x" * 50, "en", "small"), (2, "\n".join(f"heading {k}" for k in range(75)), "en", "large"), (3, "y" * 60, "en", "none")])
    assert rows("accepted_books_any", spark, sf_dir) == [("large", 75), ("small", 1)] == oracle("accepted_books_any", sf_dir)


@pytest.mark.parametrize("name", ["outline_files_strict", "outline_files_naive", "candidate_files"])
def test_outline_files_of_books_with_pages_in_several_ranges(spark, tables, name):
    """With joins that are planned with shuffles and turn out to be small, as on large tables."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k, None) for k in held}
    pages = [k * 30_000 + b for k in range(40) for b in range(3)]
    sf_dir = tables([(p, f"line {p}\n{'x' * 50}\nend of {p}, \"so\"", "en", f"s{p % 3}") for p in pages])
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert rows(name, spark, sf_dir) == oracle(name, sf_dir)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_outline_files_of_books_without_a_name(spark, tables):
    sf_dir = tables([(1, "one", "en", "s"), (2, "two\nthree", "en", None)])
    assert rows("outline_files_strict", spark, sf_dir) == oracle("outline_files_strict", sf_dir)

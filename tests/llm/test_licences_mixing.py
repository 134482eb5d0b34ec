"""op5 against the same steps in Python, op6 against the definition of a Pfair schedule."""

import hashlib
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from foliomill.llm import licences as L
from foliomill.llm import mixing as M

WHOLE = Path("/usr/share/common-licenses")


def canonical(text):
    x = (text or "").lower()
    for a, b in L.SPELLINGS:
        x = x.replace(a, b)
    x = re.sub(L.COPYRIGHT, r"\1", re.sub(L.RUNNING, r"copyright_\1\2", x))
    return re.sub(r"[ \n]+", " ", re.sub(r"[^a-z0-9\n]+", " ", x)).strip(" ")


def test_op5(docs):
    mit = L.LICENCES["MIT"]
    british = "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n(C) 1999 Other, all rights reserved\n" + mit.replace("sublicense", "sub-licence").replace(", ", " ,  ").upper()
    rows = [(1, mit), (2, british), (3, mit + " or not"), (4, None), (5, ""), (6, "Copyright 2001 X"), (7, "text\n  Released under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nreleased under the mit license\nmore"), (8, "x" * 300_000), (1, mit), (9, "see: Released under the MIT License.")]
    rows += [(20 + k, t) for k, t in enumerate(L.LICENCES.values())]
    got = {}
    for x in L.scan(docs(rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows) and len(got[1]) == 2
    for i, t in rows:
        assert got[i][0].text_digest == hashlib.sha256(canonical(t).encode()).hexdigest()
    assert got[1][0].license == got[2][0].license == "MIT" and got[3][0].license is None
    assert [got[20 + k][0].license for k in range(len(L.LICENCES))] == list(L.LICENCES)
    assert got[7][0].notices == "CC-BY-NC-4.0,MIT" and got[9][0].notices == "" and got[6][0].notices == ""
    assert L.scan(docs([])).count() == 0


@pytest.mark.skipif(not WHOLE.is_dir(), reason="the folder of whole licences isn't here")
def test_op5_whole_licences(docs):
    """Whole published texts are found by their digests alone: in capitals, with other marks and a copyright line in front, but not with a word more."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows, want = [], []
    for file, name in names.items():
        text = (WHOLE / file).read_text()
        rows += [text, "Copyright 2024 Someone\n" + text.upper(), "\n".join("// " + line for line in text.split("\n")), text + " more"]
        want += [name, name, name, None]
        if "END OF TERMS AND CONDITIONS" in text:
            rows.append(text[: text.index("END OF TERMS AND CONDITIONS") + 27])
            want.append(name)
    found = {x.doc_id: x for x in L.scan(docs(list(enumerate(rows)))).collect()}
    assert [found[k].license for k in range(len(rows))] == want
    assert found[0].text_digest == hashlib.sha256(canonical(rows[0]).encode()).hexdigest() and len(L.DIGESTS) == len({d for _, d in L.DIGESTS})
    only = {x.license for x in L.scan(docs([(0, rows[0])]), licences=[("MIT", L.LICENCES["MIT"])]).collect()}
    assert only == {None}


def test_op5_copyright_lines(docs):
    mit = L.LICENCES["MIT"]
    heads = ["Copyright Jane Doe", "Portions copyright (c) 2019 acme", "some parts Copyright 2020 by X", "Copyright: 1999-2001 Élan", "# COPYRIGHT © Someone", "All rights reserved."]
    kept = ["copyright holders of works before 2000 agree", "copyright owners", "the copyright of 2001 is ours"]
    rows = [(k, f"{h}\n{mit}") for k, h in enumerate(heads + kept)]
    got = {x.doc_id: x.license for x in L.scan(docs(rows)).collect()}
    assert [got[k] for k in range(len(rows))] == ["MIT"] * len(heads) + [None] * len(kept)


def test_op5_wrapped_texts_match_in_spark_and_sql(spark, tmp_path):
    """Every known text, wrapped and commented as in source files, below a copyright line; the SQL sees the same."""
    rows, want = [], {}
    for name, text in L.LICENCES.items():
        for width, prefix in ((30, ""), (60, "# "), (72, " * "), (79, "// ")):
            lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False)]
            k = len(rows)
            rows.append((k, "\n".join(prefix + x for x in ["Copyright (c) 2021 The Authors", "(C) 2020 Other", "© Someone", *lines])))
            want[k] = name
    rows += [(9_000, None), (9_001, "Copyright by me"), (9_002, "copyright notice and this permission notice appear in all copies")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in L.op5_licences(spark, str(tmp_path)).collect()}
    assert {k: got[k].license for k in want} == want
    assert got[9_000].text_digest == got[9_001].text_digest != got[9_002].text_digest
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.execute(L.ORACLE_SQL).fetchall()} == {k: (x.text_digest, x.license, x.notices) for k, x in got.items()}
    more = spark.createDataFrame([("X", "Some Long Licence text.")], "license string, known_text string")
    assert L.scan(spark.createDataFrame([(1, "some long license: TEXT")], "doc_id bigint, text string"), licences=more).first().license == "X"


def test_op6_column_names_cannot_clash(spark):
    rows = [(k, f"t{k}", f"s{k % 3}") for k in range(100)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    other = plain
    for name in ("w", "blocks", "period", "s", "k", "p", "c", "t", "at", "phase", "rank", "members", "class", "block_", "s_", "r_", "count", "mix_slot", "mix_block"):
        other = other.withColumn(name, F.lit(7))
    key = lambda df: sorted((r.doc_id, r.mix_block, r.mix_slot, r.mix_position) for r in df.collect())
    out = M.mix(other)
    assert key(out) == key(M.mix(plain)) and len(set(out.columns)) == len(out.columns) and out.where("w = 7 and s = 7 and blocks = 7").count() == 100


def test_op5_runs_no_python(docs):
    plan = L.scan(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("seed", range(40))
def test_pfair_windows_and_deviation(seed):
    r = random.Random(seed)
    w = {f"s{k}": r.randint(1, 9) for k in range(r.randint(1, 8))}
    total, seen = sum(w.values()), dict.fromkeys(w, 0)
    for t, s in enumerate(M.one_period(w)):
        j = seen[s]
        assert j * total // w[s] <= t < -(-(j + 1) * total // w[s])
        seen[s] += 1
        assert all(abs(seen[x] - (t + 1) * w[x] / total) < 1 for x in w)
    assert seen == w


def sequential(blocks, weights):
    """Slot by slot, earliest deadline first, a new phase when a source runs out."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while active := {s: weights.get(s, 1) for s, n in left.items() if n}:
        k = 0
        line = M.one_period(active)
        while all(left[s] for s in active):
            s = line[k % len(line)]
            out.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            k += 1
    return out


def test_op6_is_the_sequential_schedule(docs):
    r = random.Random(6)
    rows = [(k, "t", "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(700)]
    weights = {"a": 2, "b": 3, None: 1}
    got = M.mix(docs(rows), weights, block=4).collect()
    assert len(got) == 700 and all(x.score == x.doc_id for x in got)
    by_source = {}
    for x in got:
        by_source.setdefault(x.source, []).append(x)
    blocks = {s: -(-len(v) // 4) for s, v in by_source.items()}
    line = {b: k for k, b in enumerate(sequential(blocks, weights))}
    for s, v in by_source.items():
        places = sorted((x.mix_block, x.mix_position) for x in v)
        assert places == [(k // 4, k % 4) for k in range(len(v))]
    assert all(x.mix_slot == line[x.source, x.mix_block] for x in got)


def test_op6_edges(spark, docs):
    assert M.mix(docs([])).count() == 0
    same = M.mix(docs([(1, "a", "en", "s"), (1, "a", "en", "s"), (1, "b", "en", "s")]), block=2).collect()
    assert sorted((x.mix_slot, x.mix_position) for x in same) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        M.mix(docs([(1, "a", "en", "s")]), {"s": 0})
    ordered = M.mix(docs([(k, "x", "en", f"s{k % 3}") for k in range(50)]), {}, block=1, order_rows=True)
    assert ordered.count() == 50 and ordered.agg(F.max("mix_slot")).first()[0] == 49


def placed(spans, slots):
    """(source, block): slot, from the tables of a schedule."""
    at = {(x["p"], x["c"], x["k"]): x["at"] for x in slots}
    out = {}
    for x in spans:
        for n in range(x["blocks"]):
            number = n * x["members"] + x["rank"]
            q, k = divmod(number, x["w"] * x["members"])
            key = x["s"], x["first_block"] + n
            assert key not in out
            out[key] = x["first_slot"] + q * x["period"] + at[x["phase"], x["class"], k]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_phases_are_the_sequential_schedule(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(M, "PART", r.choice([7, 1_000_000]))
    blocks = {s: r.choice([1, 1, 2, 3, r.randint(1, 60)]) for s in [None, *(f"s{k}" for k in range(r.randint(0, 14)))]}
    weights = {s: r.choice([1, 1, 1, 2, 3, 4]) * r.choice([1, 1, 2]) for s in blocks if r.random() < 0.8}
    parts = list(M.phases(blocks, weights))
    got = placed(*([row for p in parts for row in p[i].to_pylist()] for i in (0, 1)))
    assert got == {b: k for k, b in enumerate(sequential(blocks, weights))}
    assert all(sum(p[i].num_rows for p in parts) <= sum(blocks.values()) for i in (0, 1))


def test_op6_schedules_thousands_of_sources(docs, monkeypatch):
    rows = [(k, "t", "en", f"s{min(k % 3_000, k % 1_700)}") for k in range(7_000)]
    of = {k: s for k, _, _, s in rows}
    blocks = {s: -(-n // 2) for s, n in Counter(of.values()).items()}
    weights = {"s5": 3, "s6": 2}
    line = placed(*(t.to_pylist() for t in next(M.phases(blocks, weights))))
    assert sorted(line.values()) == list(range(sum(blocks.values())))
    for most in (200_000, 100):
        monkeypatch.setattr(M, "MOST_SHARED", most)
        got = M.mix(docs(rows, extra=False), weights, block=2).collect()
        assert len(got) == 7_000 and all(x.mix_slot == line[x.source, x.mix_block] for x in got)

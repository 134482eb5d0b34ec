"""Encodings, workbooks, responses, deadlines and batches that arrive as a stream."""

import io
import random
import time
import zipfile

from foliomill.functions import encoding as E
from foliomill.operators import candidates as C
from foliomill.sources import outlines, spreadsheets
from foliomill.streaming import batching

WORDS = ["und", "der", "Straße", "größer", "the", "of", "naïve", "été", "où", "garçon", "señor", "mañana", "über", "with", "café", "Öl"]


def texts(seed, n, most=60):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randrange(1, most))) for _ in range(n)]


def brute_likelihood(model_text, data, name):
    """The log-likelihood of data by plain counts of pairs, or of units of two bytes."""
    from collections import Counter
    from math import log

    raw = model_text.encode(name, "ignore")
    if name.startswith("utf-16"):
        n = Counter(raw[i : i + 2] for i in range(0, len(raw) - 1, 2))
        total = sum(n.values()) + E.UNSEEN * 65_536
        return sum(log((n[data[i : i + 2]] + E.UNSEEN) / total) for i in range(0, len(data) // 2 * 2, 2))
    n, first = Counter(zip(raw, raw[1:], strict=False)), Counter(raw[:-1])
    return sum(log((n[p] + E.UNSEEN) / (first[p[0]] + E.UNSEEN * 256)) for p in zip(data, data[1:], strict=False))


def test_A9_detection_is_the_likeliest_of_the_possible():
    learned = texts(1, 300)
    models, whole = E.Models(learned), "\n".join(learned)
    right = 0
    for k, t in enumerate(texts(2, 120)):
        name = E.ENCODINGS[k % len(E.ENCODINGS)]
        data = t.encode(name)
        found, sure = models.detect(data)
        able = [e for e in E.ENCODINGS if E.possible(data, e)]
        if not (found == "utf-8" and not data.isascii()):
            score = {e: brute_likelihood(whole, data, e) for e in able}
            assert found == max(able, key=score.get) or max(score.values()) - score[found] < 1e-3
        assert 0 < sure <= 1
        right += models.decode(data)[0] == t
    assert right >= 0.97 * 120
    assert models.decode(b"\xef\xbb\xbfab")[:2] == ("ab", "utf-8") and models.decode("ab".encode("utf-16"))[0] == "ab"
    assert models.decode(None) == (None, None, 0.0) and models.decode(b"")[0] == ""


def test_A9_texts_in_capitals_and_copies(spark):
    """What was learned of small letters tells encodings apart in capitals too, and a text with many copies counts once."""
    rows = [(t,) for t in texts(1, 300)] + [("xyz",)] * 5_000
    models = outlines.learned_encodings(spark.createDataFrame(rows, "text string"))
    capitals = [t.upper() for t in texts(4, 60)]
    assert [t for t in capitals for e in E.ENCODINGS if models.decode(t.encode(e))[0] != t] == []
    nothing = outlines.learned_encodings(spark.createDataFrame([(None,)], "text string"))
    assert [nothing.decode(x)[0] for x in (b"", None)] == ["", None]


def test_A9_A10_files_in_many_encodings(spark, tmp_path):
    lines = [f"1,{t},{k}" for k, t in enumerate(texts(3, 24, 12))]
    for k, line in enumerate(lines):
        (tmp_path / f"book{k:02d}.toc").write_bytes(line.encode(E.ENCODINGS[k % 6]))
    models = outlines.learned_encodings(spark.createDataFrame([(t,) for t in texts(1, 300)] + [(None,)], "text string"))
    good, bad = outlines.read_strict(spark, str(tmp_path), "gt", models=models)
    assert {r.book: r.heading for r in good.collect()} == {f"book{k:02d}": x.split(",")[1] for k, x in enumerate(lines)} and bad.count() == 0
    (tmp_path / "x.toc").write_bytes("1,é,2".encode("latin-1"))
    assert outlines.read_naive(spark, str(tmp_path), "gt", pattern="x.toc").count() == 0
    assert outlines.read_naive(spark, str(tmp_path), "gt", pattern="x.toc", single_byte="ISO-8859-1").first().heading_naive == "é"


def test_A13_workbooks_come_back(spark, tmp_path):
    rows = [("a", 'x & <y> "z"', 1, 2.5, None), ("a", " lead ", -7, None, "n"), ("b", "É\n2", 10**12, 0.1, "drop me")]
    df = spark.createDataFrame(rows, "who string, File string, n bigint, v double, Notes string")
    books = spreadsheets.workbooks(df, "who").collect()
    for r in books:
        (tmp_path / f"{r.who}.xlsx").write_bytes(r.content)
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    found = spreadsheets.read_dimension(spark, str(tmp_path), ["v", "File", "n", "gone", "Notes"], drop=["Notes"]).collect()
    got = {(r.path.rsplit("/", 1)[-1], r.book, r.n, r.v, r.gone) for r in found}
    want = {(f"{w}.xlsx", f[:-4].lower(), str(n), None if v is None else repr(v), None) for w, f, n, v, _ in rows}
    assert got == want | {("broken.xlsx", None, None, None, None)}
    assert spreadsheets.read_dimension(spark, str(tmp_path), ["n"], pattern="a.xlsx").count() == 2
    assert [spreadsheets.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(spreadsheets.column_number(spreadsheets.column_name(k) + "9") == k for k in range(900))


def test_A13_shared_strings_and_gaps():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="B1" t="s"><v>1</v></c><c r="D1"><v>5</v></c></row><row><c t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert list(spreadsheets.sheet_rows(out.getvalue())) == [[None, "two", None, "5"], ["one"]]


def test_S12_a_late_book_is_a_reject_and_the_others_are_whole(spark):
    rows = spark.createDataFrame([(f"book{b}", k, 1, f"book{b} h{k}", k, 2) for b in range(10) for k in range(5)], "book string, seq int, level int, heading string, page int, tokens int")

    def slow_for_one(batch, context):
        if batch[0]["heading"].startswith("book3"):
            time.sleep(60)
        return batch

    began = time.time()
    good, late = C.refine_within(rows, 1.0, slow_for_one, limit=6)
    assert [tuple(r) for r in late.collect()] == [("book3", "TIME_LIMIT")]
    assert {r.book: r["count"] for r in good.groupBy("book").count().collect()} == {f"book{b}": 5 for b in range(10) if b != 3}
    assert time.time() - began < 50


def test_D8_replay(spark):
    batches = spark.createDataFrame([("b", 0), ("b", 1), ("c", 0), ("b", 0)], "book string, batch int")
    stored = spark.createDataFrame([("b", 0, '"1","One, ""x""","4"\n"2","Two","iv"\nbad'), ("c", 0, '"1","C","1"'), ("c", 7, '"1","unasked","1"'), ("c", 0, '"1","D","1"')], "book string, batch int, raw string")
    good, bad = C.replayed(batches, stored)
    assert sorted((r.book, r.batch, r.heading, r.page) for r in good.collect()) == [("b", 0, 'One, "x"', 4), ("c", 0, "C", 1)]
    assert sorted((r.book, r.batch, r.reason) for r in bad.collect()) == [("b", 0, "NOT_A_ROW"), ("b", 1, "NO_RESPONSE")]


def test_D6_D7_as_a_stream_over_several_triggers(spark, tmp_path):
    r = random.Random(1)
    rows = {b: [(b, k, r.choice(["x", "y", "z"]), r.randrange(0, 9)) for k in range(r.randrange(1, 40))] for b in range(6)}
    schema, folder = "book bigint, seq bigint, level string, tokens bigint", str(tmp_path / "in")
    out = str(tmp_path / "out")
    for part in range(3):  # each call of collected() takes what has arrived since
        some = [x for v in rows.values() for x in v[len(v) * part // 3 : len(v) * (part + 1) // 3]]
        r.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        found = batching.collected(batching.token_batches(spark.readStream.schema(schema).parquet(folder), 20), out)
    got = {(x.book, x.seq): (x.batch, x.context_levels) for x in found.collect()}
    assert found.count() == len(got) == sum(map(len, rows.values()))
    for b, v in rows.items():
        want = C.greedy_batches([t for *_, t in v], 20).tolist()
        for (_, k, _, _), n in zip(v, want, strict=True):
            opened = want.index(n)
            assert got[b, k] == (n, len({level for _, s, level, _ in v if s < opened}))


def test_A9_decoded_rows(spark):
    df = spark.createDataFrame([(1, bytearray("été où".encode("cp850"))), (2, None)], "doc_id int, content binary")
    got = {r.doc_id: r.text for r in outlines.decoded(df, E.Models(texts(1, 300))).collect()}
    assert got == {1: "été où", 2: None}

"""Files in and out: outlines, layout XML, segments, scores, the stream."""

import json

import pytest
from pyspark.sql import functions as F

from foliomill.operators import trees
from foliomill.runtime import time_limit
from foliomill.sources import layout_xml, outlines, pdf, segments
from foliomill.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    (tmp_path / "basic.toc").write_text('1,Alpha,1\n2,"Beta, part one",1\n2,Gamma,3\n1,Delta,4\n', newline="")
    (tmp_path / "crlf.toc").write_bytes(b"\xef\xbb\xbf" + b'1,Alpha,1\r\n2,"Beta, part one",1\r\n2,Gamma,3\r\n1,Delta,4\r\n')
    (tmp_path / "arity.toc").write_text("1,Alpha,Extra,1\n1,Alpha\n1,Good,2\n")
    (tmp_path / "slash.toc").write_text("1,A\\éB,2\n")
    (tmp_path / "latin.toc").write_bytes("1,é,2\n".encode("latin-1"))
    (tmp_path / "empty.toc").write_text("")
    return tmp_path


def test_A5_strict(spark, folder):
    good, rejects = outlines.read_strict(spark, str(folder), "gt", pattern="*.toc")
    rows = {}
    for r in good.orderBy("book", "seq").collect():
        rows.setdefault(r.book, []).append((r.level, r.heading, r.page))
    assert rows["basic"] == rows["crlf"] == [(1, "Alpha", 1), (2, "Beta, part one", 1), (2, "Gamma", 3), (1, "Delta", 4)]
    assert rows["arity"] == [(1, "Good", 2)] and rejects.where("book = 'arity'").count() == 2
    assert rows["slash"] == [(1, "AéB", 2)]
    assert "latin" not in rows and "empty" not in rows


def test_A6_naive(spark, folder):
    rows = outlines.read_naive(spark, str(folder), "gt", pattern="*.toc")
    found = [tuple(r) for r in rows.where("book = 'basic'").orderBy("seq").select("level", "heading_naive").collect()]
    assert found == [(1, "Alpha"), (2, "Beta"), (2, "Gamma"), (1, "Delta")]
    assert [r[0] for r in rows.where("book = 'arity'").orderBy("seq").select("heading_naive").collect()] == ["Alpha", "Alpha", "Good"]


def test_A9_A10_other_encodings_are_set_apart(spark, folder):
    assert [r.path.rsplit("/", 1)[1] for r in outlines.files(spark, str(folder), "*.toc").where("not encoding_ok").collect()] == ["latin.toc"]


def test_A14_round_trip(spark, folder, tmp_path):
    good, _ = outlines.read_strict(spark, str(folder), "gt", pattern="basic.toc")
    lines = [r.line for r in outlines.entry_lines(good).orderBy("seq").collect()]
    assert lines == ["1,Alpha,1", '2,"Beta, part one",1', "2,Gamma,3", "1,Delta,4"]
    outlines.write_outlines(good, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("system = 'gt'").count() == 4


def test_A4_A19_pending(spark):
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book string")
    assert [r.book for r in outlines.pending(books, books.where("book = 'a'"), books.where("book = 'c'")).collect()] == ["b"]


XML = '<pdf2xml><fontspec id="0" size="9.5"/><page number="4"><text top="10" left="3" font="0">ab <b>cd</b> ef</text><text top="10" font="1">x</text><text top="20" font="0"> </text></page></pdf2xml>'


def test_A7_A8_B9_mixed_content(spark):
    rows = layout_xml.elements(spark.createDataFrame([("b", XML), ("broken", "<a>")], "book string, content string")).collect()
    first = rows[0]
    assert (first.page, first.text_full, first.text_head, first.text_inline, first.bold, first.italic, first.font_size) == (4, "ab cd ef", "ab ", "cd ef", True, False, 9.5)
    assert [r.problem is not None for r in rows] == [False, False, False, True]
    usable = layout_xml.usable(layout_xml.elements(spark.createDataFrame([("b", XML)], "book string, content string")))
    assert usable.count() == 1  # the second font is unknown, the third text is empty


def test_A11_A16_segments(spark, tmp_path):
    (tmp_path / "segments_x.json").write_text(json.dumps([{}, {"level": 1, "heading": "H", "content": ["a b", None]}]))
    rows = segments.read_segments(spark, str(tmp_path), "gt").orderBy("sec_seq").collect()
    assert rows[0].heading is None and rows[0].content is None and rows[0].book == "x"
    assert rows[1].content == ["a b", None]
    both = spark.createDataFrame([("good", 0, None, None), ("good", 1, 1, "H"), ("bad", 0, None, None)], "book string, sec_seq int, level int, heading string")
    rejected = segments.write_segments(both, str(tmp_path / "out"))
    assert [r.book for r in rejected.collect()] == ["bad"] and spark.read.json(str(tmp_path / "out")).count() == 2


def test_A12_A17_literals_become_json(spark, tmp_path):
    (tmp_path / "b.json").write_text(segments.literal_to_json("[(0, 'H', 'x\\ny'), (1, 'K', None)]"))
    (row,) = segments.read_layout(spark, str(tmp_path), "b.json").collect()
    assert row.book == "b" and [(i.level, i.heading, i.content) for i in row["items"]] == [(0, "H", "x\ny"), (1, "K", None)]
    with pytest.raises(ValueError):
        segments.literal_to_json("__import__('os').getcwd()")


def test_A13_A18_dimension_and_scores(spark, tmp_path):
    (tmp_path / "d.csv").write_text("File,Group,Extra\nBook-A.pdf,G,1\n")
    assert [tuple(r) for r in segments.read_dimension(spark, str(tmp_path / "d.csv"), ["Extra"]).select("book", "Group").collect()] == [("book-a", "G")]
    scores = spark.createDataFrame([("b", "s", "etd", 3.0)], "book string, system string, metric string, value double")
    segments.write_scores(scores, str(tmp_path / "s"))
    assert segments.read_scores(spark, str(tmp_path / "s")).first().value == 3.0


def test_streamed_outlines_come_once(spark, folder, tmp_path):
    for _ in range(2):
        q = ingest.start(ingest.outline_stream(spark, str(folder), "gt", pattern="*.toc"), str(tmp_path / "tab"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "tab"))
    assert rows.where("book = 'basic'").count() == 4 and rows.select("book").distinct().count() == 4
    assert trees.depth(rows.select("book", "level", "seq")).where("book = 'basic'").first().depth == 2


def test_column_choice(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b")], "text_head string, text_inline string")
    assert [r[0] for r in rows.select(layout_xml.content_choice().alias("x")).collect()] == ["a", "b", "b"]
    assert rows.select(F.lit(1)).count() == 3


def test_A2_conversion_is_pluggable(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"?")

    def convert(content):
        if content == b"?":
            raise ValueError("empty")
        return f"<pdf2xml><page number='1'><text>{content.decode()}</text></page></pdf2xml>"

    rows = {r.book: r for r in pdf.read_pdfs(spark, str(tmp_path), convert).collect()}
    assert rows["a"].problem is None and "one" in rows["a"].content and rows["b"].problem == "ValueError: empty"
    assert layout_xml.elements(pdf.read_pdfs(spark, str(tmp_path), convert).where("problem is null")).first().text_full == "one"


def test_A3_outline_entries(spark):
    raw = spark.createDataFrame([("b", 0, 1, '"Intro" \x00', "d1", None, None), ("b", 1, 1, "Index", None, "d1", ""), ("b", 2, 2, "Part", None, "", "gone"), ("b", 3, 2, '""', None, None, None)], "book string, seq int, level int, title string, dest string, action string, element string")
    refs = spark.createDataFrame([("b", "d1", "objref", None, 5)], "book string, ref string, kind string, next_ref string, page int")
    got = [(r.seq, r.heading, r.page) for r in pdf.outline_rows(raw, refs, "gt", ["index"]).orderBy("seq").collect()]
    assert got == [(0, 'Intro"', 5), (2, "Part", None)]


def test_D12_part_of_a_run(spark):
    books = spark.createDataFrame([(x,) for x in "dbca"], "book string")
    assert [r.book for r in outlines.nth(books, 1, 3).collect()] == ["b", "c"]


def test_S12_time_limit(spark):
    import time

    slow = spark.range(4).repartition(4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id").alias("x"))
    began = time.time()
    with pytest.raises(Exception), time_limit(spark, 1):  # noqa: B017
        slow.collect()
    assert time.time() - began < 15
    with time_limit(spark, 60):
        assert spark.range(3).count() == 3


def test_A14_A15_A17_files_round_trip(spark, tmp_path):
    rows = [("a/b c", 3, 1, 'Beta, "one"', 2), ("a/b c", 1, 2, "Älpha", 1), ("x+y", 0, 1, "Gamma", None), ("none", 0, 1, None, 4)]
    toc = spark.createDataFrame(rows, "book string, seq int, level int, heading string, page int")
    outlines.write_outline_csv(toc, str(tmp_path / "o"))
    files = list((tmp_path / "o").glob("book=*/part-*"))
    assert len(files) == 2 and all(f.read_bytes().startswith(b"\xef\xbb\xbf") and f.read_bytes().count(b"\xef\xbb\xbf") == 1 for f in files)
    good, _ = outlines.read_strict(spark, str(tmp_path / "o"), "gt")
    assert sorted((r.book, r.seq, r.level, r.heading, r.page) for r in good.collect()) == [("a/b c", 0, 2, "Älpha", 1), ("a/b c", 1, 1, 'Beta, "one"', 2), ("x+y", 0, 1, "Gamma", None)]
    left = outlines.write_candidates(toc, str(tmp_path / "c"))
    assert sorted(r.book for r in left.collect()) == ["none", "x+y"]
    assert [f.read_text() for f in (tmp_path / "c").glob("book=*/part-*")] == ['2,Älpha,1\n1,"Beta, ""one""",2\n']
    outlines.write_texts(toc.selectExpr("book", "heading as text").where("book = 'x+y'"), str(tmp_path / "t"))
    assert [f.read_text() for f in (tmp_path / "t").glob("book=*/part-*")] == ["Gamma\n"]
    layout = spark.createDataFrame([("b", [(0, "H", "one\ntwo"), (1, None, None)])], "book string, items array<struct<level: int, heading: string, content: string>>")
    segments.write_layout(layout, str(tmp_path / "l"))
    (text,) = [f.read_text() for f in (tmp_path / "l").glob("book=*/part-*")]
    assert text == "[(0, 'H', 'one two'), (1, None, None)]\n" and '"one two"' in segments.literal_to_json(text)


def test_A9_encodings(spark, tmp_path):
    line = "1,Ünder,3"
    for name, encoding in (("u16.toc", "utf-16"), ("l1.toc", "latin-1"), ("u8.toc", "utf-8-sig")):
        (tmp_path / name).write_bytes(line.encode(encoding))
    found = {r.path.rsplit("/", 1)[-1]: (r.content, r.encoding_ok) for r in outlines.files(spark, str(tmp_path), "*.toc").collect()}
    assert found == {"u16.toc": (line, True), "l1.toc": (None, False), "u8.toc": (line, True)}
    assert {r.content for r in outlines.files(spark, str(tmp_path), "*.toc", single_byte="ISO-8859-1").collect()} == {line}


def test_B16_tokenizer(spark):
    from foliomill.functions import text as T

    rows = spark.createDataFrame([("abc d",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.token_count("x", list)).collect()] == [5, None]


def test_layouts_reach_workers_by_bytes(spark, tmp_path):
    """What a worker gets at once doesn't grow with the books of its task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    layout = spark.range(3).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("book"), F.array(F.struct(F.lit(1).alias("level"), F.lit("h").alias("heading"), F.lit("a 'b'").alias("content"))).alias("items"))
    segments.write_layout(layout, str(tmp_path / "layouts"))
    sized = spark.range(2_000).coalesce(1).select(F.octet_length(F.repeat(F.lit("x"), 20_000 + F.col("id").cast("int") * 0)).alias("n"), F.repeat(F.lit("x"), 20_000 + F.col("id").cast("int") * 0).alias("text"))
    at_once = F.pandas_udf(lambda t, n: n * 0 + len(t), "bigint")
    assert sized.select(at_once("text", F.col("n").cast("bigint")).alias("k")).agg(F.max("k")).first()[0] * 20_000 <= 2 * (4 << 20)
    assert sorted((r.book, r["items"][0].content) for r in segments.read_literals(spark, str(tmp_path / "layouts")).collect()) == [(f"b{k}", "a 'b'") for k in range(3)]

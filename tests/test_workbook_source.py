"""Workbooks as a data source, and outline files by partitions of books."""

import pytest
from pyspark.sql import functions as F

from foliomill.sources import outlines
from foliomill.sources import workbook_source as W

OUTLINE = "book string, seq int, level int, heading string, page int"


def test_A13_workbooks_come_back(spark, tmp_path):
    names = ["plain", "a b", "ü/§", "50%"]
    rows = [(n, k, f"t{k}, \"<&>\"" if k % 3 else None) for n in names for k in range(5)] + [(None, 9, "lost")]
    W.write_workbooks(spark.createDataFrame(rows, "book string, k int, `odd``name` string"), "book", str(tmp_path / "w"))
    found = W.scan_workbooks(spark, f"file://{tmp_path}/w")
    assert found.columns == ["workbook", "row", "k", "odd`name"]
    assert sorted((r[0], int(r[2]), r[3] or "") for r in found.collect()) == sorted((b, k, t or "") for b, k, t in rows if b)
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_")]


def test_A13_only_named_workbooks_are_opened(spark, tmp_path):
    W.write_workbooks(spark.createDataFrame([("a", 1), ("b", 2)], "book string, k int"), "book", str(tmp_path))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "notes.txt").write_text("not one either")
    rows = {tuple(r) for r in W.scan_workbooks(spark, str(tmp_path), columns=["k", "gone"]).collect()}
    assert rows == {("a", 0, "1", None), ("b", 0, "2", None), ("c", None, None, None)}
    (tmp_path / "c.xlsx").unlink()
    (tmp_path / "c.xlsx").symlink_to(tmp_path / "a.xlsx")
    chosen = W.scan_workbooks(spark, str(tmp_path), workbooks=["b", "nobody"])
    assert [tuple(r) for r in chosen.collect()] == [("b", 0, "2")]
    # two uses of one DataFrame don't disturb each other
    whole = W.scan_workbooks(spark, str(tmp_path))
    assert whole.where("workbook = 'a'").count() == 1 and whole.count() == 3
    assert len(W.WorkbookReader({"path": str(tmp_path), "partition_bytes": "1"}, ["k"]).partitions()) == 3
    assert len(W.WorkbookReader({"path": str(tmp_path)}, ["k"]).partitions()) == 1


def test_A13_jobs_that_fail_leave_nothing_and_empty_folders_have_no_rows(spark, tmp_path):
    from pyspark.sql.types import Row

    folder = str(tmp_path / "w")
    writer = W.WorkbookWriter({"path": folder}, ["k"], False)
    done = writer.write(iter([Row("a", 1), Row("a", 2)]))
    writer.abort([done, None])
    assert list((tmp_path / "w").iterdir()) == []
    again = [writer.write(iter([Row("a", 1)])), writer.write(iter([Row("a", 2)]))]
    with pytest.raises(ValueError, match="several pieces"):
        writer.commit(again)
    assert not list((tmp_path / "w").glob("*.xlsx"))
    writer.abort(again)
    for where in ("w", "missing"):
        found = W.scan_workbooks(spark, str(tmp_path / where))
        assert found.columns == ["workbook", "row"] and found.count() == 0
    for mode, names in (("append", ["a", "b"]), ("overwrite", ["c"])):
        for n in names:
            W.write_workbooks(spark.createDataFrame([(n, 1)], "book string, k int"), "book", folder, mode=mode)
        assert sorted(p.name for p in (tmp_path / "w").iterdir()) == [f"{n}.xlsx" for n in names]
    W.write_workbooks(spark.createDataFrame([], "book string, k int"), "book", str(tmp_path / "none"))
    assert W.scan_workbooks(spark, str(tmp_path / "none")).count() == 0


def shelf(spark, folder):
    rows = [(b, k, k % 3 + 1, f"{h} {k}", k) for b in ("0012", "a=b/c d", "z") for k, h in enumerate(["plain", 'q"uote', "com,ma", "back\\\\slash"])]
    outlines.write_outline_csv(spark.createDataFrame(rows, OUTLINE), folder)
    return rows


def test_A5_a_filter_on_the_book_opens_its_file_only(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = shelf(spark, folder)
    good, bad = outlines.read_shelf(spark, folder, "gt")
    kept = sorted((b, k, v, h.replace("\\\\", "\\"), p) for b, k, v, h, p in rows)
    assert sorted(tuple(r)[1:] for r in good.collect()) == kept and bad.count() == 0
    strict, _ = outlines.read_strict(spark, folder, "gt")
    assert sorted(map(tuple, strict.collect())) == sorted(map(tuple, good.collect()))
    # the files of all other books can't be read any more: their checksums are wrong
    for crc in (tmp_path / "s").glob("book=*/.*.crc"):
        if "book=0012" not in str(crc):
            crc.write_bytes(crc.read_bytes()[:-4] + b"\x00\x01\x02\x03")
    fresh, _ = outlines.read_shelf(spark, folder, "gt")
    assert sorted(tuple(r)[1:] for r in fresh.where("book = '0012'").collect()) == [r for r in kept if r[0] == "0012"]
    asked = spark.createDataFrame([("0012", 1), ("z", 2)], "book string, n int").where(F.col("n") == 1)
    assert fresh.join(F.broadcast(asked), "book", "left_semi").count() == 4
    with pytest.raises(Exception, match="(?i)checksum"):
        fresh.collect()


def test_A5_shelves_with_rejects_and_strange_files(spark, tmp_path):
    for book, data in {"x": b"1,one,2\n3,short\n\n4,a,b,c\n", "latin": "1,é,2".encode("latin-1"), "mark": "﻿1,é,2".encode(), "empty": b"", "__HIVE_DEFAULT_PARTITION__": b"1,h,no page\n"}.items():
        (tmp_path / f"book={book}").mkdir()
        (tmp_path / f"book={book}" / "part-0.txt").write_bytes(data)
    good, bad = outlines.read_shelf(spark, str(tmp_path), "gt")
    assert sorted((tuple(r)[1:] for r in good.collect()), key=str) == sorted([("x", 0, 1, "one", 2), ("mark", 0, 1, "é", 2), (None, 0, 1, "h", None)], key=str)
    assert sorted(((r.book, r.seq, r.fields) for r in bad.collect()), key=str) == sorted([("x", 1, ["3", "short"]), ("x", 2, []), ("x", 3, ["4", "a", "b", "c"]), ("latin", None, None)], key=str)

"""op2: an exact round trip, segments in any order, and what is wrong with broken ones."""

import base64
import gzip
import hashlib
import random

import pyarrow as pa
import pytest

from foliomill.llm import warc as W


def sha(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id bigint, url string, html string, record_id string")


@pytest.mark.parametrize(("segment", "least"), [(64, 0), (1 << 16, 0), (100, 5)])
def test_round_trip(spark, tmp_path, segment, least):
    r = random.Random(segment)
    texts = ["", None, "abc", "abc", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n", "é" * 500, "0\r\n\r\n", *["".join(r.choices("ab<>é\r\n", k=r.randrange(400))) for _ in range(30)]]
    rows = [(k, None if k == 3 else f"http://x/{k}\n", t) for k, t in enumerate(texts + texts[:8])]
    W.write_archives(pages(spark, rows), str(tmp_path / "w"), segment=segment, least_revisit=least, archive=2_000)
    got = {x.record_id: x for x in W.read_archives(spark, str(tmp_path / "w")).collect()}
    first = {}
    for i, _, t in rows:
        first.setdefault(t or "", i)
    assert len(got) == len(rows)
    for i, _, t in rows:
        b, g = (t or "").encode(), got[f"<urn:page:{i}>"]
        again = first[t or ""] != i and len(b) >= least
        assert (g.payload_bytes, g.payload_digest, g.problem) == (len(b), sha(b), None)
        assert g.record_type == ("revisit" if again else "response") and g.refers_to == (f"<urn:page:{first[t or '']}>" if again else None)


def test_chunked():
    for x in (b"", b"abc", b"\r\n" * 9000):
        assert W.unchunked(W.chunked(x, 7)) == x
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"\r\n"):
        with pytest.raises(ValueError):
            W.unchunked(bad)


def test_reassembly():
    parts = [(2, None, b"b"), (3, 3, b"c"), (1, None, b"a")]
    assert W.reassembled(parts) == b"abc"
    for bad in (parts[:2], parts[::2][:1] + [parts[2]], [*parts, (3, 3, b"c")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (2, None, b"b")]):
        with pytest.raises(ValueError):
            W.reassembled(bad)


def test_broken_archives_are_reported(spark, tmp_path):
    a = W.record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<c>"), ("WARC-Segment-Origin-ID", "<o>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", 5)], b"xy")
    (tmp_path / "part-1").write_bytes(a + W.END)
    (tmp_path / "part-2").write_bytes(b"junk")
    wrong = W.record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Payload-Digest", "sha1:" + sha(b"other"))], b"HTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "part-3").write_bytes(wrong + W.END)
    got = {x.record_id.rsplit("/", 1)[-1]: x for x in W.read_archives(spark, str(tmp_path)).collect()}
    assert got["<o>"].problem and got["part-2"].problem and got["<r>"].problem and not got["<r>"].payload_digest


def test_members(spark, tmp_path):
    """Other tools read the archives as gzip, record by record; archives of several members are read whole."""
    r = random.Random(3)
    rows = [(k, "http://x/" + "u" * r.choice([5, 70_000]), "".join(r.choices("ab é", k=r.choice([0, 10, 9_000, 200_000])))) for k in range(25)]
    W.write_archives(pages(spark, rows), str(tmp_path / "w"))
    records = [x for f in (tmp_path / "w").glob("part-*") for x in W.records(gzip.decompress(f.read_bytes()))]
    segmented = {h["warc-segment-origin-id"] for h, _ in records if "warc-segment-origin-id" in h}
    assert len(segmented) > 5 and all(len(b) <= W.SEGMENT for _, b in records)
    plain = [W.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>")], b"x" * k) + W.END for k in range(300)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-1").write_bytes(b"".join(map(gzip.compress, plain)))
    (tmp_path / "m" / "part-2").write_bytes(gzip.compress(plain[0])[:-3])
    got = {x.record_id.rsplit("/", 1)[-1]: x for x in W.read_archives(spark, str(tmp_path / "m")).collect()}
    assert len(got) == 301 and all(got[f"<{k}>"].payload_digest == sha(b"x" * k) for k in range(300)) and got["part-2"].problem


def test_archives_of_any_name_are_read(spark, tmp_path):
    one = W.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<a>")], b"abc") + W.END
    for name in ("part-0.warc.gz", "CC-0001.warc.gz", "sub/x"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress(one))
    (tmp_path / "plain.warc").write_bytes(one * 3)
    assert W.read_archives(spark, str(tmp_path)).count() == 6
    assert W.read_archives(spark, str(tmp_path), pattern="CC-*").count() == 1


def test_records_are_taken_one_by_one(monkeypatch):
    """Any step, any cut of records into members: no more is held than a record and a step."""
    r = random.Random(6)
    some = [W.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>")], bytes(r.choices(b"ab\r\n", k=r.choice([0, 1, 50, 3_000])))) + W.END for k in range(60)]
    raw = b"".join(some)
    for step in (1, 7, 1_000, 1 << 16):
        monkeypatch.setattr(W.Archive, "FED", step)
        for cut in (1 << 20, 997):
            for data in (raw, b"".join(gzip.compress(raw[i : i + cut]) for i in range(0, len(raw), cut))):
                found = list(W.records(data))
                assert [h["warc-record-id"] for h, _ in found] == [f"<{k}>" for k in range(60)]
                assert b"".join(W.record([("WARC-Type", "resource"), ("WARC-Record-ID", h["warc-record-id"])], b) + W.END for h, b in found) == raw
    with pytest.raises(ValueError, match="cut short"):
        list(W.records(gzip.compress(raw)[:-9]))


def test_most_pages_go_out_in_segments():
    assert len(list(W.page_records(1, "u", b"x" * 2_151, None, W.SEGMENT))) == 2


def test_revisits_are_checked(spark, tmp_path):
    one = list(W.page_records(1, "u", b"abc", None, 2)) + list(W.page_records(2, "u", b"abc", 1, 9)) + list(W.page_records(3, "u", b"abd", 1, 9)) + list(W.page_records(4, "u", b"abc", 9, 9))
    (tmp_path / "part-1").write_bytes(b"".join(x + W.END for x in one))
    got = {x.record_id: (x.payload_bytes, x.problem) for x in W.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"<urn:page:1>": (3, None), "<urn:page:2>": (3, None), "<urn:page:3>": (None, "the response has another payload"), "<urn:page:4>": (None, "no response with this id")}


def test_empty_table(spark, tmp_path):
    W.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("segment", [64, 1 << 16])
def test_repeated_and_null_ids(spark, tmp_path, segment):
    long = {c: c * 70_000 for c in "ABCDE"}
    rows = [(5, long["A"]), (5, long["B"]), (3, long["B"]), (7, long["C"]), (7, long["C"]), (8, long["C"]), (None, long["D"]), (None, long["D"]), (None, long["E"]), (None, None), (9, "x"), (2, long["E"])]
    rows = [(i, f"http://x/{k}", t) for k, (i, t) in enumerate(rows)]
    W.write_archives(pages(spark, rows), str(tmp_path / "w"), segment=segment, archive=100_000)
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert len({x.record_id for x in got}) == len(got) == len(rows) and not any(x.problem for x in got)
    by_url, by_id = {x.uri: x for x in got}, {x.record_id: x for x in got}
    for i, url, t in rows:
        b, x = (t or "").encode(), by_url[url]
        assert (x.payload_bytes, x.payload_digest) == (len(b), sha(b)) and x.record_id.startswith(f"<urn:page:{i}")
        first = min((k for k, _, u in rows if u == t and k is not None), default=None)
        assert x.record_type == ("response" if i is None or i == first else "revisit")
        if x.refers_to:
            of = by_id[x.refers_to]
            assert of.record_type == "response" and of.payload_digest == sha(b) and of.record_id.startswith(f"<urn:page:{first}")
    assert by_url["http://x/9"].record_id != by_url["http://x/8"].record_id and by_url["http://x/10"].record_id == "<urn:page:9>"


def test_op2_gives_repeated_ids_as_they_are(spark, tmp_path):
    rows = [(5, "u", "A" * 70_000), (5, "v", "B" * 70_000), (3, "w", "B" * 70_000), (None, "x", "C"), (None, "y", "C")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = {x.url: (x.page_id, x.record_type, x.refers_to, x.payload_bytes, x.problem) for x in W.op2_warc(spark, str(tmp_path)).collect()}
    assert got == {"u": (5, "response", None, 70_000, None), "v": (5, "revisit", 3, 70_000, None), "w": (3, "response", None, 70_000, None), "x": (None, "response", None, 1, None), "y": (None, "response", None, 1, None)}


def test_neighbouring_segments_travel_together():
    """In archives, in one of which they come in order and in the other backwards: the same segments, but fewer and smaller rows."""
    payload = ("<p>Some text of a page, " * 1_000).encode()
    made = list(W.page_records(7, "http://a", payload, None, 2_048))
    sent = []
    for part in (made, made[::-1]):
        raw = b"".join(one + W.END for one in part)
        batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([raw], pa.binary())], ["path", "content"])
        rows = [r["part"] for b in W._read(iter([batch])) for r in b.to_pylist()]
        found = [x for r in rows for x in W._segments(r)]
        assert sorted(n for n, _, _ in found) == list(range(1, len(made) + 1))
        assert W.payload_of(W.reassembled(found)) == payload
        sent.append((len(rows), sum(len(r["piece"]) for r in rows)))
    assert sent[0][0] == 1 and sent[1][0] == len(made) > 5 and 3 * sent[0][1] < sent[1][1]

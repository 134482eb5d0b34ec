"""WARC writing and reading with segment reassembly.

Writing: every page becomes a response record, or a revisit of the record with the smallest id that has the same payload, if
the payload has at least `least_revisit` bytes. A payload goes out in chunked transfer framing, and a block longer than
`segment` bytes is cut: a first record with WARC-Segment-Number 1 and continuation records that name it in
WARC-Segment-Origin-ID; the last of them has the total length. Each record is a gzip member of its own (several, beyond MEMBER bytes).
Spark's text writer writes the archives, so they go to any file system and a lost task is written again: a member of less than 64 KiB
ends with two zero bytes, the upper half of its length, and these are the line separator.

Reading: archives, plain or of any number of gzip members, are framed by Content-Length alone. Records in one piece are decoded
where they are read. Segments are dealt by origin, neighbouring ones together, ordered by number, checked for gaps and against the total length, and then
decoded. A revisit has the length of the response it refers to, and a problem if there is none or its digest is another.

Edge cases: a null page is the empty payload and an empty payload is written and revisited as any other; a null or repeated url is
written as written as it is; every row is a record of its own: where several rows have one id, or none, a record's name is the id, the
payload's SHA-1 and a number among the rows that are equal in both; a null id is written as None, and is never a revisit; an incomplete or inconsistent
set of segments, and a framing that does not parse, is returned with its `problem` and without a digest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, shared_folder, table, written

#: Bytes of a block above which it is cut, bytes of a transfer chunk, bytes of payload in one archive, and bytes of a record in one gzip member.
SEGMENT, CHUNK, ARCHIVE, MEMBER = 2 << 10, 1 << 10, 8 << 20, 60_000
END, MEMBER_END = b"\r\n\r\n", b"\0\0"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; ValueError if it isn't one. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:end].split(b";")[0].strip() or b"?", 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def members(record: bytes) -> list[bytes]:
    """gzip members without their last two bytes, which are MEMBER_END."""
    out = []
    for i in range(0, len(record), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        one = z.compress(record[i : i + MEMBER]) + z.flush()
        out.append(one.removesuffix(MEMBER_END))
    return out


class Archive:
    """The bytes of an archive, plain or of gzip members, from front to back: no more is held than a record and a step of FED bytes."""

    FED = 64 << 10

    def __init__(self, raw: bytes | memoryview):
        self.raw, self.at, self.zipped = memoryview(raw), 0, bytes(raw[:2]) == b"\x1f\x8b"
        self.held, self.open = bytearray(), None

    def more(self) -> bool:
        """Takes another step; False at the end."""
        if self.at >= len(self.raw):
            if self.open:
                raise ValueError("gzip member cut short")
            return False
        fed = self.raw[self.at : self.at + self.FED]
        self.at += len(fed)
        if not self.zipped:
            self.held += fed
            return True
        self.open = self.open or zlib.decompressobj(31)
        self.held += self.open.decompress(fed)
        if self.open.eof:
            self.at -= len(self.open.unused_data)
            self.open = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which goes as well; None if it doesn't come."""
        seen = 0
        while (end := self.held.find(mark, max(seen - len(mark), 0))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def ended(self) -> bool:
        while not self.held:
            if not self.more():
                return True
        return False


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def page_records(page: object, url: str | None, payload: bytes, refers_to: object | None, segment: int) -> Iterator[bytes]:
    common = [("WARC-Target-URI", _clean(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), *common]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield record(first, block)
        return
    yield record([*first, ("WARC-Segment-Number", 1)], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{k}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{page}>"), ("WARC-Segment-Number", k), *total], piece)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The html, which is the last column, compressed."""
    for batch in batches:
        html = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        packed = pa.array([None if x is None else zlib.compress(x, 6) for x in html], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], batch.schema.names)


def _written(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    equal: Counter = Counter()  # rows that are equal in id and payload are all in one task
    for batch in batches:
        out = []
        for name, sha, url, packed, repeated, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            record_name = name
            if repeated:
                record_name = f"{name};{sha};{equal[name, sha]}"
                equal[name, sha] += 1
            for one in page_records(record_name, url, zlib.decompress(packed) if packed else b"", refers, segment):
                out += members(one + END)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def plan(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """(payload_sha1, refers_to) for payloads that occur more than once and have at least `least_revisit` bytes."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.where(F.octet_length("html") >= least_revisit).select("page_id", F.sha1("html").alias("payload_sha1"))
    return rows.groupBy("payload_sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT, least_revisit: int = 0, archive: int = ARCHIVE) -> None:
    """Writes gzip archives of about `archive` payload bytes. The html is shuffled once, compressed, dealt by the id and payload."""
    spark = pages.sparkSession
    bounded_batches(spark)
    size = pages.agg(F.coalesce(F.sum(F.octet_length(html_col) + 600), F.lit(0))).first()[0]
    first = plan(pages, id_col=id_col, html_col=html_col, least_revisit=least_revisit)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    sha = F.sha1(F.coalesce(html_col, F.lit("")))
    light = pages.select(F.col(id_col).alias("page_id"), name(id_col).alias("page_name"), sha.alias("payload_sha1"))
    repeated = light.groupBy("page_name").count().where("count > 1").select("page_name", F.lit(True).alias("repeated"))
    # the name of the record that others refer to: the first of the equal rows, if its id is repeated
    first = first.withColumn("page_name", name("refers_to")).join(repeated, "page_name", "left")
    first = first.select("payload_sha1", "refers_to", F.when(F.col("repeated"), F.concat_ws(";", "page_name", "payload_sha1", F.lit("0"))).otherwise(F.col("page_name")).alias("target"))
    # ids and payloads that revisit another record; a join of narrow rows, whose hot payloads adaptive execution can split
    again = light.join(first, "payload_sha1").where(F.col("page_id") != F.col("refers_to")).select("page_name", "payload_sha1", "target", F.lit(None).cast("boolean").alias("repeated"))
    twice = light.join(repeated, "page_name").select("page_name", "payload_sha1", F.lit(None).cast("string").alias("target"), "repeated")
    marks = again.unionAll(twice).groupBy("page_name", "payload_sha1").agg(F.max("target").alias("target"), F.max("repeated").alias("repeated"))
    rows = pages.select(name(id_col).alias("page_name"), sha.alias("payload_sha1"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(_packed, "page_name string, payload_sha1 string, url string, html binary")
    n, key = max(1, -(-size // archive)), ["page_name", "payload_sha1"]
    rows = rows.repartition(n, *key).join(marks.repartition(n, *key), key, "left").select(*key, "url", "html", "repeated", "target")
    lines = rows.mapInArrow(lambda x: _written(x, segment), "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", MEMBER_END.decode()).text(folder)


def records(raw: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record of an archive, by Content-Length."""
    archive, number = Archive(raw), 0
    while not archive.ended():
        lines = archive.until(END)
        if lines is None or not lines.startswith(b"WARC/"):
            raise ValueError(f"record {number} doesn't begin as one")
        head = {}
        for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        block = archive.take(int(head["content-length"]))
        if archive.take(4) != END:
            raise ValueError(f"record {number} is not {head['content-length']} bytes long")
        yield head, block
        number += 1


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: the body, freed of chunked framing. Any other block is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total or None, piece) segments in any order; ValueError if they don't fit together."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments missing or repeated")
    block, totals = b"".join(s[2] for s in segments), [s[1] for s in segments if s[1] is not None]
    if totals != [len(block)] or segments[-1][1] is None:
        raise ValueError("total length missing or different")
    return block


RESULT = "record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string"
PIECE = "origin string, number int, total long, head string, sizes array<int>, piece binary"
_RESULT = pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
_PIECE = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("sizes", pa.list_(pa.int32())), ("piece", pa.binary())])


def _answer(head: dict[str, str], block: bytes) -> dict:
    out = {"record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": head.get("warc-refers-to")}
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    try:
        if out["record_type"] == "revisit":
            lengths = [x for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            return out | {"payload_bytes": int(lengths[0].split(b":")[1]), "payload_digest": stated}
        payload = payload_of(block)
        found = digest(payload)
        if stated and stated != found:
            raise ValueError(f"payload has digest {found}")
        return out | {"payload_bytes": len(payload), "payload_digest": found}
    except (ValueError, IndexError) as e:
        return out | {"problem": str(e)}


_BOTH = pa.schema([("whole", pa.struct(_RESULT)), ("part", pa.struct(_PIECE))])
#: Records and bytes of their pieces that a task sends on at once.
SENT_ROWS, SENT_BYTES = 2_000, 4 << 20
#: Bytes of neighbouring segments of one record that travel as one piece.
RUN_BYTES = 1 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to rows of `whole` (records in one piece) and `part` (segments; such as follow each other in an archive and by number are one row, with their sizes, as they compress better together)."""
    found: list[dict] = []
    run: dict | None = None
    blocks: list[bytes] = []

    def close() -> None:
        nonlocal run
        if run:
            found.append({"whole": None, "part": run | {"sizes": [len(b) for b in blocks], "piece": zlib.compress(b"".join(blocks), 6)}})
            blocks.clear()
            run = None

    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.clear()
            size = held = 0
            try:
                for head, block in records(memoryview(raw.as_buffer())):
                    number = head.get("warc-segment-number")
                    if number is None:
                        found.append({"whole": _answer(head, block), "part": None})
                    else:
                        total = head.get("warc-segment-total-length")
                        origin = head.get("warc-segment-origin-id", head.get("warc-record-id"))
                        keep = "\n".join(f"{k}:{v}" for k, v in head.items() if number == "1")
                        if run and (run["origin"], run["number"] + len(blocks), run["total"]) != (origin, int(number), None) or held + len(block) > RUN_BYTES:
                            close()
                        if not run:
                            run, held = {"origin": origin, "number": int(number), "head": keep}, 0
                        run["total"] = int(total) if total else None
                        blocks.append(block)
                        held += len(block)
                        size += len(block)
                    if len(found) >= SENT_ROWS or size >= SENT_BYTES:
                        close()
                        yield pa.RecordBatch.from_pylist(found, _BOTH)
                        found.clear()
                        size = 0
            except (ValueError, KeyError, zlib.error) as e:
                found.append({"whole": {"record_id": path, "problem": f"archive: {e}"}, "part": None})
            close()
            if found:
                yield pa.RecordBatch.from_pylist(found, _BOTH)


def _segments(run: dict) -> Iterator[tuple[int, int | None, bytes]]:
    """(number, total or None, piece) of the segments that travelled as one row; only the last has a total."""
    data, at = zlib.decompress(run["piece"]), 0
    for k, size in enumerate(run["sizes"], 1):
        yield run["number"] + k - 1, run["total"] if k == len(run["sizes"]) else None, data[at : at + size]
        at += size


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of origin to a row for each origin."""
    origin, rows, found = None, [], []

    def close() -> None:
        heads = [r["head"] for r in rows if r["number"] == 1 and r["head"]]
        head = dict(x.split(":", 1) for x in heads[0].split("\n")) if heads else {"warc-record-id": origin}
        try:
            found.append(_answer(head, reassembled([x for r in rows for x in _segments(r)])))
        except ValueError as e:
            found.append({"record_id": origin, "record_type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "problem": str(e)})
        rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["origin"] != origin and rows:
                close()
            origin = row["origin"]
            rows.append(row)
        if found:
            yield pa.RecordBatch.from_pylist(found, _RESULT)
            found.clear()
    if rows:
        close()
        yield pa.RecordBatch.from_pylist(found, _RESULT)


def read_archives(spark, folder: str, *, pattern: str = "*") -> DataFrame:
    """A row for each record of the archives below a folder whose names match: RESULT. Only segments, compressed, and what revisits name are shuffled.

    An archive is one value of a task, so of less than 2 GiB; its records are taken from it one by one.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    both = files.mapInArrow(_read, f"whole struct<{_ddl(RESULT)}>, part struct<{_ddl(PIECE)}>")
    # One pass over the archives: what needs no joining goes to the origin null, spread by its own id.
    dealt = both.repartition(F.coalesce("part.origin", "whole.record_id"))
    found = written(dealt.sortWithinPartitions("part.origin", "part.number").mapInArrow(_either, RESULT), "records")
    revisit = F.col("record_type") == "revisit"
    named = found.where(F.coalesce(~revisit, F.lit(True)) & F.col("problem").isNull()).select(F.col("record_id").alias("target"), F.col("payload_bytes").alias("its_bytes"), F.col("payload_digest").alias("its_digest"))
    named = named.groupBy("target").agg(F.min(F.struct("its_bytes", "its_digest")).alias("its")).select("target", "its.*")
    checked = found.where(revisit & F.col("problem").isNull()).join(named, F.col("refers_to") == F.col("target"), "left")
    good = F.coalesce(F.col("its_digest") == F.col("payload_digest"), F.lit(False)) & F.coalesce(F.col("its_bytes") == F.col("payload_bytes"), F.lit(False))
    wrong = F.when(F.col("target").isNull(), "no response with this id").otherwise("the response has another payload")
    names = ["record_id", "uri", "record_type", "refers_to"]
    checked = checked.select(*names, F.when(good, F.col("its_bytes")).alias("payload_bytes"), F.when(good, F.col("its_digest")).alias("payload_digest"), F.when(~good, wrong).alias("problem"))
    return found.where(F.coalesce(~revisit, F.lit(True)) | F.col("problem").isNotNull()).unionByName(checked)


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records as they are, segments through _joined."""

    def segments() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_part = batch.column(1).is_valid()
            whole = batch.column(0).filter(pa.compute.invert(is_part))
            if len(whole):
                held.append(pa.RecordBatch.from_arrays(whole.flatten(), _RESULT.names))
            parts = batch.column(1).filter(is_part)
            if len(parts):
                yield pa.RecordBatch.from_arrays(parts.flatten(), _PIECE.names)
            elif held:
                yield pa.RecordBatch.from_pylist([], _PIECE)

    held: list[pa.RecordBatch] = []
    for out in _joined(segments()):
        yield from held
        held.clear()
        yield out
    yield from held


def _ddl(x: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (f.split() for f in x.split(", ")))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    found = read_archives(spark, folder)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)(?:;[^>]*)?>", 1)
    return found.select(
        F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to").cast("long")).alias("refers_to"), F.col("uri").alias("url"), "problem",
    )


# A Base32 character is 5 bits, so 5 hexadecimal digits are 4 of them.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url, CAST(NULL AS VARCHAR) AS problem
FROM f
"""

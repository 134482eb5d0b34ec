"""Ranked lexical search by block maxima (Block-Max WAND) over an inverted index of the whole corpus.

1. One pass counts documents and terms; these two numbers fix the weight of a document's length, and so the impact of each posting.
2. Each task makes shards of about SHARD_BYTES of text as it reads them, without a shuffle. A shard has one row for each term: its postings in blocks of BLOCK,
   compressed by gaps and variable bytes, with each block's last document and largest impact; and one row, of the empty term, for its documents.
3. A search reads the shards' rows of the query's terms. A task goes through its shards one after another and keeps the k best of each item so far.
   The ends of the blocks of all terms cut a shard into intervals. Shallow pointers, one for each term, move along these ends without touching
   a posting, and give each interval the sum of its blocks' maxima. Pivots are taken from the interval with the largest sum on; blocks are decompressed only
   where the sum still reaches the item's k-th best score, and all documents of such an interval are scored at once, with every term. A shard in which the
   sum of the terms' maxima stays below is left as a whole.
4. The k best of the tasks are ranked together.

The items go through in blocks of about ITEM_BYTES of terms, each broadcast; an item's own terms have to fit into a worker.

Edge cases: a null or empty text, or one without a term, is in no posting and doesn't count as a document; an item without terms has no rows; rows that share an
item_id, null included, are one item with the terms of all of them; rows that share a doc_id are documents of their own; a document without
an id comes after the others of its score; ids that aren't integers are numbered in their order; empty tables give an empty result; other columns are ignored. A term of a
weight of 0 adds nothing, as the formula says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .ranges import INTEGERS, numbered
from .session import bounded_batches, discard, in_blocks, table, written

BLOCK = 128
#: Bytes of text and rows of one shard, bytes of terms of the items that are broadcast at once, and shards that one task searches, about.
SHARD_BYTES, SHARD_ROWS, ITEM_BYTES, SHARDS = 8 << 20, 1 << 16, 4 << 20, 16
TOP = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 11
#: Intervals that are scored before the threshold is looked at again, at first; twice as many each time.
FIRST = 4

IS_TERM = np.zeros(256, bool)
IS_TERM[0x80:] = IS_TERM[0x30:0x3A] = IS_TERM[0x41:0x5B] = IS_TERM[0x61:0x7B] = True


def length_weights(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 100 - 50 + (50 * n * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1_000 * math.log((2 * documents + 2) / (2 * df + 1)))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable bytes, seven bits each, the last without the high bit; and the end of each value."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[(ends - size)[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts)


# ---- the index --------------------------------------------------------------------------------------------------

INDEX = "shard bigint, term string, df int, lasts binary, peaks binary, ends binary, posts binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = size = 0
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(0))
        size += len(data)
        for i, j in K.slices(offsets):
            bounds = offsets[i : j + 1] - offsets[i]
            starts, _ = K.words(data[offsets[i] : offsets[j]], bounds, IS_TERM)
            n = np.diff(np.searchsorted(starts, bounds))
            documents += int((n > 0).sum())
            terms += len(starts)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (documents, terms, size)], ["documents", "terms", "bytes"])


def _binary(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose row k is flat[cuts[k] : cuts[k + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def shard_rows(shard: int, ids: np.ndarray, missing: np.ndarray, data: np.ndarray, bounds: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    """The rows of a shard: ids and missing are those of its documents, data and bounds their texts."""
    data = K.lowered(data)
    starts, ends = K.words(data, bounds, IS_TERM)
    n = np.diff(np.searchsorted(starts, bounds))
    m = length_weights(n, documents, terms) if terms else n
    _, hashes, once, at = K.vocabulary(data, starts, ends, SEED)
    of = np.repeat(np.arange(len(n)), n)
    key, tf = np.unique(at.astype(np.int64) * max(len(n), 1) + of, return_counts=True)
    term, doc = np.divmod(key, max(len(n), 1))
    first = np.searchsorted(term, np.arange(len(hashes) + 1))
    place = np.arange(len(term)) - first[term]
    starts_block = np.flatnonzero(place % BLOCK == 0)
    ends_block = np.append(starts_block[1:], len(term))
    before = np.where(place == 0, -1, np.concatenate([[0], doc[:-1]])) if len(doc) else doc
    bytes_, byte_ends = packed(np.stack([doc - before - 1, tf - 1], 1).ravel())
    peaks = np.maximum.reduceat(impacts(tf, m[doc]), starts_block) if len(doc) else doc
    block_ends = byte_ends[2 * ends_block - 1]
    cuts = np.searchsorted(starts_block, first)
    byte_cuts = np.concatenate([[0], block_ends])[cuts]
    inner_ends = block_ends - np.repeat(byte_cuts[:-1], np.diff(cuts))
    size = ends[once] - starts[once]
    texts = _binary(data[K.aranges(starts[once], size)], np.concatenate([[0], np.cumsum(size)]))
    one = [pa.array([x], t) for x, t in ((shard, pa.int64()), (b"", pa.binary()), (len(n), pa.int32()), (m.astype(np.int64).tobytes(), pa.binary()), (missing.tobytes(), pa.binary()), (b"", pa.binary()), (ids.tobytes(), pa.binary()))]
    rest = [
        pa.array(np.full(len(hashes), shard)), texts, pa.array(np.diff(first).astype(np.int32)), _binary(doc[ends_block - 1].astype(np.int32), cuts),
        _binary(peaks.astype(np.int32), cuts), _binary(inner_ends.astype(np.int32), cuts), _binary(bytes_, byte_cuts),
    ]
    columns = [pa.concat_arrays([a, b]) for a, b in zip(one, rest, strict=True)]
    columns[1] = columns[1].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "lasts", "peaks", "ends", "posts"])


def _sharded(batches: Iterator[pa.RecordBatch], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = rows = 0
    shard = TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        ids, missing, data, bounds = (list(x) for x in zip(*held, strict=True))
        at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        return shard_rows(shard, np.concatenate(ids), np.concatenate(missing), np.concatenate(data), np.concatenate([[0], *[b[1:] + a for a, b in zip(at, bounds)]]), documents, terms)

    for batch in batches:
        data, offsets = K.column_bytes(batch.column(1))
        missing = np.asarray(batch.column(0).is_null())
        ids = batch.column(0).fill_null(0).to_numpy()
        for i, j in K.slices(offsets):
            held.append((ids[i:j], missing[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            size, rows = size + int(offsets[j] - offsets[i]), rows + j - i
            if size >= SHARD_BYTES or rows >= SHARD_ROWS:
                yield flush()
                held, size, rows, shard = [], 0, 0, shard + 1
    if held:
        yield flush()


@dataclass
class Index:
    """The table of the shards, the number of documents with a term, of terms, and of bytes; ids: (number, id) where ids aren't integers."""

    rows: DataFrame
    documents: int
    terms: int
    bytes: int
    ids: DataFrame | None = None


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all documents in the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "documents bigint, terms bigint, bytes bigint").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms", "bytes")]).first()
    documents, terms, size = counts
    whole = dict(docs.dtypes)[id_col] in INTEGERS
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("number", F.col("id").cast("bigint")) if whole else numbered(rows, "id", "number")
    ids = None if whole else written(rows.select("number", "id").distinct(), "ids")
    made = rows.select("number", "text").mapInArrow(lambda x: _sharded(x, documents, terms), INDEX)
    return Index(written(made, "postings"), documents, terms, size, ids)


# ---- the search -------------------------------------------------------------------------------------------------


class Shard:
    """The postings of a shard for the terms of a search, decompressed block by block where they are needed."""

    def __init__(self, rows: dict[str, tuple]):
        _, m, missing, _, ids = rows[""]
        self.m, self.missing, self.ids = np.frombuffer(m, np.int64), np.frombuffer(missing, bool), np.frombuffer(ids, np.int64)
        self.rows = rows
        self.lists: dict[str, tuple] = {}
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Last documents of the blocks, and their maxima with a 0 behind, without a block being decompressed; and the largest."""
        if term not in self.lists:
            _, lasts, peaks, _, _ = self.rows[term]
            peaks = np.frombuffer(peaks, np.int32).astype(np.int64)
            self.lists[term] = np.frombuffer(lasts, np.int32), np.append(peaks, 0), int(peaks.max())
        return self.lists[term]

    def block(self, term: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k."""
        if (term, k) not in self.open:
            _, lasts, _, ends, posts = self.rows[term]
            ends = np.frombuffer(ends, np.int32)
            values = unpacked(np.frombuffer(posts, np.uint8)[ends[k - 1] if k else 0 : ends[k]])
            doc = np.cumsum(values[::2] + 1) + (np.frombuffer(lasts, np.int32)[k - 1] if k else -1)
            self.open[term, k] = doc, impacts(values[1::2] + 1, self.m[doc])
        return self.open[term, k]


class Best:
    """The k best documents of an item so far: scores, ids, and whether the id is missing."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.missing = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.missing, missing])
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.id, self.missing = score[order], ids[order], missing[order]


def search_shard(shard: Shard, query: list[tuple[str, int]], best: Best) -> None:
    """Takes the documents of a shard that belong to the best of a query of (term, weight)."""
    lists = [(t, w, *shard.postings(t)) for t, w in query if w > 0 and t in shard.rows]
    if not lists or sum(w * top for _, w, _, _, top in lists) < best.threshold:
        return
    cuts = np.unique(np.concatenate([lasts for _, _, lasts, _, _ in lists]))
    pointers = [np.searchsorted(lasts, cuts) for _, _, lasts, _, _ in lists]
    bound = np.zeros(len(cuts), np.int64)
    for (_, w, _, peaks, _), at in zip(lists, pointers, strict=True):
        bound += w * peaks[at]
    order = np.argsort(-bound, kind="stable")
    done, step = 0, FIRST
    while done < len(order) and bound[order[done]] >= best.threshold:
        some = order[done : done + step]
        some = np.sort(some[bound[some] >= best.threshold])
        done, step = done + step, 2 * step
        chosen = np.zeros(len(cuts), bool)
        chosen[some] = True
        score = np.zeros(len(shard.ids), np.int64)
        for (t, w, lasts, _, _), at in zip(lists, pointers, strict=True):
            for k in np.unique(at[some]).tolist():
                if k < len(lasts):
                    doc, impact = shard.block(t, k)
                    inside = chosen[np.searchsorted(cuts, doc)]
                    score[doc[inside]] += w * impact[inside]
        found = np.flatnonzero(score >= best.threshold)
        if len(found) > best.k:  # only the k-th best and its ties can stay
            found = found[score[found] >= np.partition(score[found], -best.k)[-best.k]]
        best.add(score[found], shard.ids[found], shard.missing[found])


def _searched(batches: Iterator[pa.RecordBatch], queries: list[list[tuple[str, int]]], k: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard after another to the k best documents of each query over all of them."""
    best = [Best(k) for _ in queries]
    now, rows = None, {}

    def finish() -> None:
        if rows and "" in rows:
            shard = Shard(rows)
            for q, b in zip(queries, best, strict=True):
                search_shard(shard, q, b)

    for batch in batches:
        columns = [batch.column(c) for c in range(7)]
        for i, shard in enumerate(columns[0].to_pylist()):
            if shard != now:
                finish()
                now, rows = shard, {}
            rows[columns[1][i].as_py()] = (columns[2][i].as_py(), *(columns[c][i].as_buffer() for c in range(3, 7)))
    finish()
    sizes = [len(b.score) for b in best]
    out = [np.repeat(np.arange(len(best)), sizes), np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)]
    ids, missing = (np.concatenate([getattr(b, x) for b in best]) if best else np.zeros(0, np.int64) for x in ("id", "missing"))
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(ids, pa.int64(), mask=missing.astype(bool))], ["query", "score", "number"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), CAPITALS, SMALL), F.lit(TERM), F.lit(0))
    rows = items.select(F.col(id_col).alias("item_id"), F.array_distinct(found).alias("terms"))
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def search(index: Index, items: DataFrame, k: int = TOP, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each item."""
    spark = index.rows.sparkSession
    bounded_batches(spark)
    wanted = item_terms(items, id_col, text_col)
    size = F.aggregate("terms", F.lit(0), lambda a, t: a + F.octet_length(t) + 32)
    shards = max(1, index.bytes // SHARD_BYTES)
    parts = min(shards, max(2 * spark.sparkContext.defaultParallelism, shards // SHARDS))
    kind = wanted.schema["item_id"].dataType.simpleString()
    out = None
    for block in in_blocks(wanted, size, ITEM_BYTES):
        terms = sorted({t for r in block for t in r.terms})
        names = F.broadcast(spark.createDataFrame([(t,) for t in ["", *terms]], "term string"))
        mine = index.rows.join(names, "term", "left_semi")
        df = {r.term: r.n for r in mine.where("term <> ''").groupBy("term").agg(F.sum("df").alias("n")).collect()}
        queries = [[(t, term_weight(index.documents, df[t])) for t in r.terms if t in df] for r in block]
        shared = spark.sparkContext.broadcast(queries)
        rows = mine.select("shard", "term", "df", "lasts", "peaks", "ends", "posts").repartition(parts, "shard").sortWithinPartitions("shard")
        found = rows.mapInArrow(lambda x, q=shared: _searched(x, q.value, k), "query bigint, score bigint, number bigint")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("number")))).where(F.col("rank") <= k)
        ids = F.broadcast(spark.createDataFrame([(q, r.item_id) for q, r in enumerate(block)], f"query bigint, item_id {kind}"))
        found = found.join(ids, "query").select("item_id", "rank", "number", "score")
        out = found if out is None else out.unionAll(found)
    if index.ids is None:
        return out.select("item_id", "rank", F.col("number").alias("doc_id"), "score")
    ids = index.ids.select(F.col("number").alias("n__"), F.col("id").alias("doc_id"))
    return out.join(ids, F.col("number") == F.col("n__"), "left").select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"))
    found = written(search(index, table(spark, sf_dir, "benchmark")), "ranked")
    discard(index.rows)
    return found


ORACLE_SQL = rf"""
WITH dt AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{TERM}') AS w FROM documents),
s AS (SELECT count(*) AS nn, sum(len(w)) AS ll FROM dt WHERE len(w) > 0),
dm AS (SELECT d, doc_id, 100 - 50 + ((50 * len(w) * nn) // ll) AS m FROM dt, s WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{TERM}')) AS term FROM benchmark),
po AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM dt) WHERE term IN (SELECT term FROM it) GROUP BY d, term),
we AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM po GROUP BY term), s),
sc AS (SELECT item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score FROM it JOIN we USING (term) JOIN po USING (term) JOIN dm USING (d) GROUP BY item_id, doc_id, d),
ra AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ra WHERE rank <= {TOP}
"""

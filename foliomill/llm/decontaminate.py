"""Benchmark decontamination with an FM-index for each shard of the corpus.

Words are coded by the vocabulary of the test items (0: any other word, and the end of a document). Each shard of
about SHARD_BYTES of text gets an FM-index: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet-tree
ranks, and sampled suffix positions. Every window of the items is looked up by backward search, its occurrences are
located, and the hit words of a document are the union of the spans.

Edge cases: a null or empty text has no words and no hits; an item without words is ignored; an item shorter than the
window is one window; repeated rows are each answered; equal items are each counted; an empty benchmark hits nothing;
an item without an id is named by the empty string;
columns other than the two named are ignored. No row is shuffled, but for benchmarks of more than ITEM_BYTES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import bounded_batches, in_blocks

WINDOW = 10
#: Bytes of text in one FM-index, and the distance of the sampled suffix positions.
SHARD_BYTES, SAMPLE = 8 << 20, 8
#: The items are broadcast below this size and go through the corpus in blocks of this size beyond it. Their windows take 8 bytes a byte
#: (a word of 6 bytes is a row of 40), and about 20 while they are made.
ITEM_BYTES = 4 << 20
#: A longer item is cut into pieces of so many bytes.
PIECE_BYTES = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x80:] = IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = True
SEED = 9


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.words(data, bounds, IS_WORD)


class Windows:
    """The distinct windows of the items as rows of vocabulary codes, right-aligned and zero-padded, with their items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.items = sorted({"" if i is None else str(i) for i, t in items})
        at = {x: k for k, x in enumerate(self.items)}
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        #: the items' bytes, where encode() looks words up
        self.data = K.lowered(np.frombuffer(b"".join(texts), np.uint8))
        starts, ends = words(self.data, bounds)
        size = np.diff(np.searchsorted(starts, bounds))
        self.seed, self.vocabulary, once, at_word = K.vocabulary(self.data, starts, ends, SEED)
        self.start, self.end = starts[once], ends[once]
        codes = at_word.astype(np.int32) + np.int32(1)
        item = np.array([at["" if i is None else str(i)] for i, _ in items], np.int32)
        first = np.cumsum(size) - size
        count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        start, of = K.aranges(first, count), np.repeat(np.arange(len(size)), count)
        length = np.minimum(size, window)[of]
        rows = np.zeros((len(start), window), np.int32)
        for k in range(window):  # right-aligned
            some = length > window - 1 - k
            rows[some, k] = codes[(start + length - window + k)[some]]
        if len(rows):
            _, once, each = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        else:
            once = each = np.zeros(0, np.int64)
        self.codes, self.length = rows[once], length[once]
        #: the items of window w are owner[cut[w] : cut[w + 1]]
        pair = np.unique(each.astype(np.int64) * max(len(self.items), 1) + item[of])
        self.owner = (pair % max(len(self.items), 1)).astype(np.int32)
        self.cut = np.searchsorted(pair // max(len(self.items), 1), np.arange(len(once) + 1))
        self.least = int(self.length.min()) if len(once) else window

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The code of each word of lower-cased bytes: found by its hash, and confirmed byte by byte."""
        out = np.zeros(len(starts), np.int32)
        if len(self.vocabulary) and len(starts):
            hashes = K.word_hashes(data, starts, ends, self.seed)
            at = np.searchsorted(self.vocabulary, hashes)
            at[at == len(self.vocabulary)] = 0
            some = np.flatnonzero(self.vocabulary[at] == hashes)
            some = some[K.same_spans(data, starts[some], ends[some], self.data, self.start[at[some]], self.end[at[some]])]
            out[some] = at[some] + 1
        return out


class FMIndex:
    """Over a sequence of codes in which 0 separates runs; each 0 counts as a symbol of its own, smallest first."""

    def __init__(self, codes: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(codes)
        zero = codes == 0
        rank = np.where(zero, np.cumsum(zero) - 1, codes.astype(np.int64) + int(zero.sum()))
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            fresh = np.empty(n, np.int64)
            fresh[0:1] = 0
            if n > 1:
                fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if not n or fresh[-1] == n - 1:
                break
            second = np.zeros(n, np.int64)
            second[:-step] = rank[step:] + 1
            rank = rank * (n + 1) + second
            order = np.argsort(rank, kind="stable")
            step *= 2
        self.bwt = codes[order - 1] if n else codes
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma + 1))])
        inside = order % sample == 0
        inside |= np.concatenate([[True], zero])[order] if n else inside
        self.sampled = inside
        self.suffix = np.where(inside, order, -1)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(~ones, out=before[1:])
            self.levels.append((bit, before, int(before[-1])))
            row = np.concatenate([row[~ones], row[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands in bwt[:at], down the wavelet tree."""
        low, high = np.zeros_like(at), at.copy()
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + low - before[low], before[low])
            high = np.where(one, zeros + high - before[high], before[high])
        return high - low

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each right-aligned pattern."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((length > k) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.sampled[rows])):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
        return self.suffix[rows] + steps


def shard_hits(codes: np.ndarray, run_of: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of all occurrences in a shard; run_of: the document of each word."""
    if not len(codes) or not len(windows.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(run_of[1:] != run_of[:-1]) + 1
    spaced = np.insert(codes, edge, 0)
    at = np.insert(np.arange(len(codes)), edge, -1)
    spaced, at = np.append(spaced, 0), np.append(at, -1)
    # Runs of words of the items; a shorter run than the shortest window holds no occurrence, and separators are merged.
    known = spaced > 0
    starts = np.flatnonzero(known & ~np.concatenate([[False], known[:-1]]))
    ends = np.flatnonzero(known & ~np.concatenate([known[1:], [False]])) + 1
    long = ends - starts >= windows.least
    keep = K.aranges(starts[long], ends[long] - starts[long] + 1)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(spaced[keep], len(windows.vocabulary))
    low, high = index.search(windows.codes, windows.length)
    found = np.flatnonzero(high > low)
    rows = K.aranges(low[found], high[found] - low[found])
    which = np.repeat(found, high[found] - low[found])
    return at[keep[index.locate(rows)]], which


def hits(batches: Iterator[pa.RecordBatch], windows: Windows, spans: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(1))
        for i, j in K.slices(offsets, SHARD_BYTES):
            codes, counts = [], []
            for a, b in K.slices(offsets[i : j + 1]):
                a, b = a + i, b + i
                part = K.lowered(data[offsets[a] : offsets[b]])
                starts, ends = words(part, offsets[a : b + 1] - offsets[a])
                codes.append(windows.encode(part, starts, ends))
                counts.append(np.diff(np.searchsorted(starts, offsets[a : b + 1] - offsets[a])))
            codes, counts = np.concatenate(codes), np.concatenate(counts)
            first = np.concatenate([[0], np.cumsum(counts)])
            doc = np.repeat(np.arange(j - i), counts)
            at, which = shard_hits(codes, doc, windows)
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + windows.length[which], -1)
            covered = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            n_hit = total[first[1:]] - total[first[:-1]]
            names: list[list[str]] = [[] for _ in range(j - i)]
            if len(at):
                pair = np.unique(doc[at].astype(np.int64) * len(windows.codes) + which)
                d, w = np.divmod(pair, len(windows.codes))
                count = windows.cut[w + 1] - windows.cut[w]
                found = np.unique(np.repeat(d, count) * len(windows.items) + windows.owner[K.aranges(windows.cut[w], count)])
                for x, k in zip(*(z.tolist() for z in np.divmod(found, len(windows.items))), strict=True):
                    names[x].append(windows.items[k])
            out = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64())]
            out.append(pa.array(names, pa.list_(pa.string())))
            fields = ["doc_id", "n_words", "n_hit", "n_items", "items"]
            if spans:
                runs = np.diff(np.concatenate([[0], (covered & True).astype(np.int8), [0]]))
                s, e = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)
                # a run over a bound of two documents counts for both
                cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(codes))]
                cut = cut[(covered[cut] & covered[cut - 1])] if len(codes) else cut
                s, e = np.unique(np.concatenate([s, cut])), np.unique(np.concatenate([e, cut]))
                k = np.searchsorted(first, s, "right") - 1
                listed: list[list[dict]] = [[] for _ in range(j - i)]
                for d, x, y in zip(k.tolist(), (s - first[k]).tolist(), (e - first[k]).tolist(), strict=True):
                    listed[d].append({"first": x, "last": y - 1})
                out.append(pa.array(listed, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(out, fields)


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Items, those of more than PIECE_BYTES in pieces of whole words that share window - 1 words with the next: they have the same windows together."""
    for batch in batches:
        row, out = [], []
        for k, text in enumerate(batch.column(1)):
            size = text.as_buffer().size if text.is_valid else 0
            if size <= PIECE_BYTES:
                row.append(k)
                out.append(text.as_py())
                continue
            data = np.frombuffer(text.as_buffer(), np.uint8)
            starts, ends = words(K.lowered(data), np.array([0, size]))
            i = 0
            while i < len(starts):
                j = max(int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")), min(i + window, len(starts)))
                row.append(k)
                out.append(data[starts[i] : ends[j - 1]].tobytes().decode())
                i = len(starts) if j >= len(starts) else j - window + 1
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.string())], ["item_id", "text"])


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ITEM_BYTES, by their cumulated size and whatever their ids are."""
    items = benchmark.select(F.col("item_id"), F.col("text"))
    items = items.mapInArrow(lambda x: _pieces(x, window), items.schema)
    return ([tuple(r) for r in rows] for rows in in_blocks(items, F.octet_length("text"), ITEM_BYTES))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items[, spans]) for each document: spans are word ranges to remove.

    Items of at most ITEM_BYTES together go through the corpus once. More go in blocks, the answers are merged by (id, text
    hash) and joined back to the rows, so that every row has its answer either way.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _blocks(benchmark, window)
    first, second = next(blocks, []), next(blocks, None)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_words bigint, n_hit bigint, n_items bigint, items array<string>"
    with_spans = schema + ", spans array<struct<first: bigint, last: bigint>>"
    if second is None:
        shared = spark.sparkContext.broadcast(Windows(first, window))
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda x: hits(x, shared.value, spans), with_spans if spans else schema)
    keyed = docs.select(_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _in_blocks(keyed, chain([first, second], blocks), window).withColumnRenamed("doc_id", "k__")
    out = keyed.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("k__")), "left")
    out = out.select(F.col("doc_id.id").alias("doc_id"), "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans")
    return out if spans else out.drop("spans")


def _key(id_col: str, text_col: str):
    return F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h"))


def _in_blocks(keyed: DataFrame, blocks: Iterable[list[tuple]], window: int) -> DataFrame:
    """(doc_id, n_words, items, spans) for each distinct doc_id, a struct of id and text hash: the items go through in blocks, and the answers are merged."""
    spark = keyed.sparkSession
    schema = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<first: bigint, last: bigint>>"
    parts = []
    for items in blocks:
        block = spark.sparkContext.broadcast(Windows(items, window))
        parts.append(keyed.mapInArrow(lambda x, b=block: hits(x, b.value, True), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out = out.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.array_sort(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] >= s["first"] - 1), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(a, F.array(s))),
    )
    return out.withColumn("spans", merged)


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; what stands around them stays."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = K.words(K.lowered(data), np.array([0, len(data)]), IS_WORD)
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : int(starts[s["first"]])])
        at = int(ends[s["last"]])
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch], windows: Windows | None) -> Iterator[pa.RecordBatch]:
    """Batches (rest..., text[, spans]) to (rest..., text without the hit words, whether anything went). Without windows the spans are given."""
    for batch in batches:
        if windows is None:
            rest, texts, spans = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
        else:
            rest, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], ["row", "text"])
            spans = [s for part in hits(iter([numbered]), windows, True) for s in part.column(5).to_pylist()]
        out = [_without(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())], [*batch.schema.names[: len(rest)], "text__cut", "touched__cut"])


def cleaned(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with the hit words cut from the texts; chars_col is counted anew where something went. No row is shuffled up to ITEM_BYTES of items; beyond, spans are joined by id and text hash."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _blocks(benchmark, window)
    first, second = next(blocks, []), next(blocks, None)
    kinds = dict(docs.dtypes)
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text__cut string", "touched__cut boolean"])
    if second is None:
        shared = spark.sparkContext.broadcast(Windows(first, window))
        out = docs.select(*rest, text_col).mapInArrow(lambda x: _cut(x, shared.value), schema)
    else:
        spans = _in_blocks(docs.select(_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text")), chain([first, second], blocks), window).select(F.col("doc_id").alias("k__"), F.col("spans").alias("spans__"))
        here = docs.withColumn("key__", _key(id_col, text_col))
        out = here.join(spans, F.col("key__").eqNullSafe(F.col("k__")), "left").select(*rest, text_col, "spans__").mapInArrow(lambda x: _cut(x, None), schema)
    columns = [F.col("text__cut").alias(c) if c == text_col else F.when(F.col("touched__cut"), F.length("text__cut").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c == chars_col else F.col(c) for c in docs.columns]
    return out.select(*columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .session import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
grams AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM pos, ks WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, i, g.k, item_id FROM grams g JOIN wins USING (g, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""

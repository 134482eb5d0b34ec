"""Finding headings and passages in text without comparing all of one with all of the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import automaton as A
from ..functions import text as T
from ..runtime import discard, importable, written

#: Bytes of keys that a task matches at once, whole pages, and the number of units or entries of one page that meet in one task.
BATCH_BYTES, PAGE_ROWS = 4 << 20, 50_000


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and int64 offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    indices = column.combine_chunks().dictionary_encode().indices
    return indices.to_numpy(zero_copy_only=False)


def _page_hits(table: pa.Table, group: np.ndarray, both_ways: bool) -> pa.RecordBatch:
    """(book, seq, hit) of the entries (kind 0) of whole pages; a page's entries stand before its units (kind 1)."""
    kind, at = table.column("kind").to_numpy(), table.column("at").to_numpy()
    data, offsets = column_bytes(table.column("loose").combine_chunks())
    whole, whole_offsets = column_bytes(table.column("exact").combine_chunks())
    heads, units = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    side = lambda rows: (offsets[rows], offsets[rows + 1], group[rows])
    hit = np.full(len(heads), A.NONE)
    if len(heads) and len(units):
        hit = np.minimum(hit, A.first_containing(data, side(heads), side(units), at[units], of_text=False))
        size = offsets[units + 1] - offsets[units]
        if both_ways:  # only a unit that isn't longer than the page's longest heading can stand in one
            most = np.zeros(int(group[-1]) + 1, np.int64)
            np.maximum.at(most, group[heads], offsets[heads + 1] - offsets[heads])
            short = units[size <= most[group[units]]]
            hit = np.minimum(hit, A.first_containing(data, side(short), side(heads), at[short], of_text=True))
        first = np.full(int(group[-1]) + 1, A.NONE)
        np.minimum.at(first, group[units], at[units])
        empty = offsets[heads + 1] == offsets[heads]
        hit[empty] = first[group[heads[empty]]]  # an empty heading is contained in every text
        # equal exact keys: lengths first, then the bytes of what is left
        length = np.diff(whole_offsets)
        wanted = np.isin(group[units] * (1 << 32) + length[units], group[heads] * (1 << 32) + length[heads])
        known: dict[tuple, int] = {}
        for k in units[wanted].tolist():
            key = group[k], whole[whole_offsets[k] : whole_offsets[k + 1]].tobytes()
            known[key] = min(known.get(key, A.NONE), int(at[k]))
        for n, k in enumerate(heads.tolist() if known else ()):
            hit[n] = min(hit[n], known.get((group[k], whole[whole_offsets[k] : whole_offsets[k + 1]].tobytes()), A.NONE))
    found = hit < A.NONE
    return pa.RecordBatch.from_arrays([table.column("book").combine_chunks().take(pa.array(heads[found])), pa.array(at[heads[found]]), pa.array(hit[found])], ["book", "seq", "hit"])


def _matched(batches: Iterator[pa.RecordBatch], both_ways: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by page and kind, to the hits of each page. A page is held until its last row has come."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        table = pa.Table.from_batches(held)
        keys = [_codes(table.column(c)) for c in ("book", "page", "part")]
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        group = np.cumsum(change)
        until = table.num_rows if last else int(np.searchsorted(group, group[-1]))
        if until:
            yield _page_hits(table.slice(0, until), group[:until], both_ways)
            held = table.slice(until).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > BATCH_BYTES:
            yield from flush(False)
            if size > BATCH_BYTES // 2:  # one large page: look again once it has doubled
                size = -size
    if sum(b.num_rows for b in held):
        yield from flush(True)


def first_hits(entries: DataFrame, units: DataFrame, texts: list[str], at: str, *, both_ways: bool = True) -> DataFrame:
    """(book, seq, hit): for each entry (book, page, seq, heading) the first unit of its page, by `at`, any of whose texts matches.

    A text matches if the exact keys are equal, or if one loose key contains the other. Both directions are one pass of an automaton each: the page's headings over its
    texts, and its short texts over its headings; entries and units are never paired. Units of pages without entries go no further. Pages with more than PAGE_ROWS of either are
    cut into parts of that size, each part of the entries with each of the units.
    """
    importable(entries.sparkSession)
    heads = entries.select("book", "page", F.lit(0).cast("tinyint").alias("kind"), F.col("seq").cast("bigint").alias("at"), F.col("heading").alias("text"))
    text = F.explode(F.array_distinct(F.array(*[F.col(t) for t in texts]))) if len(texts) > 1 else F.col(texts[0])
    found = units.select("book", "page", F.lit(1).cast("tinyint").alias("kind"), F.col(at).cast("bigint").alias("at"), text.alias("text"))
    asked = entries.select("book", "page").where("book is not null and page is not null").distinct()
    found = found.join(asked, ["book", "page"], "left_semi")  # keys are made, dealt and matched for pages with entries only
    rows = heads.unionByName(found).where("text is not null and book is not null and page is not null")
    # almost no page is large; the few that are get their numbers of parts from a count
    large = rows.groupBy("book", "page").agg(F.count_if(F.col("kind") == 0).alias("h__"), F.count_if(F.col("kind") == 1).alias("u__")).where(f"h__ > {PAGE_ROWS} or u__ > {PAGE_ROWS}")
    parts = lambda n: F.ceil(F.greatest(F.coalesce(F.col(n), F.lit(1)), F.lit(1)) / PAGE_ROWS).cast("int")
    rows = rows.join(large.withColumnsRenamed({"book": "b__", "page": "p__"}), (F.col("book") == F.col("b__")) & (F.col("page") == F.col("p__")), "left")
    mine = F.pmod(F.xxhash64("at"), F.when(F.col("kind") == 0, parts("h__")).otherwise(parts("u__"))).cast("int")
    whole = F.sequence(F.lit(0), F.when(F.col("kind") == 0, parts("u__")).otherwise(parts("h__")) - 1)
    part = F.transform(whole, lambda k: F.when(F.col("kind") == 0, mine * parts("u__") + k).otherwise(k * parts("u__") + mine))
    rows = rows.select("book", "page", F.explode(part).alias("part"), "kind", "at", T.key_loose("text").alias("loose"), T.key_exact("text").alias("exact"))
    dealt = rows.repartition("book", "page", "part").sortWithinPartitions("book", "page", "part", "kind")
    kinds = dict(entries.dtypes)
    hits = dealt.mapInArrow(lambda x: _matched(x, both_ways), f"book {kinds['book']}, seq bigint, hit bigint")
    hits = hits.groupBy("book", "seq").agg(F.min("hit").alias("hit"))
    return hits.select("book", F.col("seq").cast(kinds["seq"]).alias("seq"), F.col("hit").cast(dict(units.dtypes)[at]).alias("hit"))


# ---- passages in documents -------------------------------------------------------------------------------------

#: The longest gram in bytes, and bytes of items that go through the documents at once.
GRAM, ITEM_BYTES = 8, 4 << 20


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place on as one number; places past the end count as zeros behind it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    whole = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    return whole & np.uint64((1 << 8 * q) - 1) if q < 8 else whole.copy()


class Grams:
    """Each item by its rarest gram: the gram's bytes, its place in the item, and the item's bytes, sorted by length of gram and gram.

    How rare a gram is likely to be is told by how often its pairs of bytes stand in all items.
    """

    def __init__(self, items: list[bytes]):
        self.items = items
        self.empty = [k for k, x in enumerate(items) if not x]
        pairs = np.ones(1 << 16)
        for x in items:
            b = np.frombuffer(x, np.uint8).astype(np.int64)
            np.add.at(pairs, b[:-1] << 8 | b[1:], 1)
        often = np.log(pairs)
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for k, x in enumerate(items):
            if x:
                q = min(len(x), GRAM)
                b = np.frombuffer(x, np.uint8).astype(np.int64)
                sums = np.concatenate([[0.0], np.cumsum(often[b[:-1] << 8 | b[1:]])])
                place = int((sums[q - 1 :] - sums[: len(sums) - q + 1]).argmin())
                chosen.setdefault(q, []).append((int(_grams(b.astype(np.uint8), q)[place]), place, k))
        self.tables = {}
        for q, rows in chosen.items():
            rows.sort()
            gram = np.array([r[0] for r in rows], np.uint64)
            mark = np.zeros(1 << 16, bool)
            mark[self._slot(gram)] = True
            self.tables[q] = gram, mark, [r[1] for r in rows], [r[2] for r in rows]

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)

    def inside(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """The items that each text contains."""
        found: list[set[int]] = [set(self.empty) for _ in range(len(offsets) - 1)]
        raw = data.tobytes()
        for q, (gram, mark, places, items) in self.tables.items():
            grams = _grams(data, q)
            at = np.flatnonzero(mark[self._slot(grams)])
            low, high = np.searchsorted(gram, grams[at]), np.searchsorted(gram, grams[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            text = np.searchsorted(offsets, at, "right") - 1
            for i, t, a, b in zip(at.tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b):
                    begin = i - places[k]
                    item = self.items[items[k]]
                    if items[k] not in found[t] and begin >= offsets[t] and begin + len(item) <= offsets[t + 1] and raw.startswith(item, begin):
                        found[t].add(items[k])
        return [sorted(x) for x in found]


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """(doc_id, item_id) for each document (doc_id, text) and item (item_id, key) whose key stands in the text.

    An item is looked for by one gram of up to GRAM bytes, likely the rarest of its own: where the gram stands in a text, the bytes around it are compared with the item. Every place of every text is looked up. Items go through in blocks of about ITEM_BYTES, each broadcast. A null text or key
    matches nothing, an empty key every text; repeated rows are answered each.
    """
    spark = docs.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs, items = docs.select(doc_id, "text"), items.select(item_id, "key").where("key is not null")  # a filter on text would compute it twice
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0)), F.count(F.lit(1))).first()
    many = max(1, -(-size // ITEM_BYTES))
    schema = StructType([docs.schema[doc_id], StructField("at__", ArrayType(LongType()))])
    out = None
    for rows in _blocks(items, item_id, many):
        shared = spark.sparkContext.broadcast(Grams([r.key.encode() for r in rows]))

        def found(batches: Iterator[pa.RecordBatch], grams=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = grams.value.inside(*column_bytes(batch.column(1).fill_null("")))
                inside = [x if there else [] for x, there in zip(inside, batch.column(1).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inside, pa.list_(pa.int64()))], [doc_id, "at__"])

        names = F.broadcast(spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], StructType([StructField("k__", LongType()), items.schema[item_id]])))  # of one block
        pairs = docs.mapInArrow(found, schema).select(doc_id, F.explode("at__").alias("k__")).join(names, "k__").select(doc_id, item_id)
        out = pairs if out is None else out.unionAll(pairs)
    return out


def _blocks(items: DataFrame, item_id: str, many: int) -> Iterator[list]:
    """The items in blocks of equal numbers of rows, whatever their ids are."""
    if many == 1:
        yield items.collect()
        return
    numbered = written(items.repartition(many).select("*", F.spark_partition_id().alias("block__")), "items")
    for k in range(many):
        yield numbered.where(F.col("block__") == k).drop("block__").collect()
    discard(numbered)

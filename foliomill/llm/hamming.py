"""Approximate nearest neighbours by cosine: multi-index hashing of learned binary codes.

1. Rotations are learned on a bounded sample by iterative quantisation, so that the signs of a rotated vector, its code of BITS bits, lose least.
2. Every vector gets its code, in a table in the shared folder.
3. A search deals that table to tasks. A task takes shards of SHARD_ROWS codes, cuts the codes into substrings of about log2 of the shard's rows, and
   indexes each substring in a table of its own. The queries' substrings are probed with more and more bits flipped: once the first t + 1 of m tables
   are probed within r bits and the others within r - 1, every code within m * r + t bits has been retrieved (the pigeonhole principle), each one at the
   first probe that reaches it. Retrieved codes within the query's radius are ranked by the cosine of their vectors, in doubles.
4. A query's radius follows from the cosine s of its k-th best so far: a sign differs with probability p = acos(s) / pi, so a vector as near as that
   differs in BITS * p bits on average, and the radius is MARGIN standard deviations beyond. Until there are k, it is BITS. It shrinks with each probe
   and from shard to shard; the probes of a query end when they cover it. Nothing is capped.
5. The k best of the tasks are ranked together.

What may be missed are near vectors whose codes are beyond the radius; the rest is exact. The queries go through in blocks of about QUERY_BYTES, each broadcast.

Edge cases: vectors that are null, empty, zero, or hold a null or a component that isn't finite are neither queries nor candidates; vectors are compared with those of
their own length; rows that share an id are vectors of their own, and a query leaves out its own row alone; a candidate without an id comes after the others of
its score, and a row without one is no query; ids that aren't integers are numbered in their order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .ranges import INTEGERS, numbered
from .session import bounded_batches, discard, in_blocks, table, written

BITS, MARGIN, NEAREST = 64, 1.5, 5
#: Vectors that the rotations are learned from, at most about, and their bytes; steps of learning.
SAMPLE, SAMPLE_BYTES, STEPS = 20_000, 64 << 20, 30
SHARD_ROWS, LEAST_ROWS, QUERY_BYTES = 1 << 16, 2_048, 8 << 20
#: Probes and pairs that a task holds at once.
PROBES, PAIRS = 1 << 20, 1 << 15
SEED = 12


def learned(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(length, bits): rotations of unit vectors, as many as the bits need, each brought near to the signs that it gives."""
    length = sample.shape[1]
    random = np.random.Generator(np.random.PCG64(SEED))
    parts = []
    for _ in range(-(-bits // length)):
        rotation = np.linalg.qr(random.normal(size=(length, length)))[0]
        for _ in range(STEPS if len(sample) else 0):
            u, _, v = np.linalg.svd(sample.T @ np.where(sample @ rotation > 0, 1.0, -1.0))
            rotation = u @ v
        parts.append(rotation)
    return np.concatenate(parts, 1)[:, :bits]


def fitted(rotation: np.ndarray, length: int) -> np.ndarray:
    """The rotation for vectors of another length: shorter ones count as filled up with zeros, longer ones get random rows."""
    if length > len(rotation):
        more = np.random.Generator(np.random.PCG64(SEED + length)).normal(size=(length - len(rotation), rotation.shape[1])) / np.sqrt(length)
        rotation = np.concatenate([rotation, more])
    return rotation[:length]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which brings its largest component to about 1 and loses nothing of a cosine."""
    _, exponent = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -exponent[:, None])


def codes_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    bits = np.packbits(vectors @ fitted(rotation, vectors.shape[1]) > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 8 - bits.shape[1])))).view(np.uint64)[:, 0]


def radius(cosine: np.ndarray, bits: int, margin: float) -> np.ndarray:
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return np.minimum(np.floor(bits * p + margin * np.sqrt(bits * p * (1 - p))), bits).astype(np.int64)


class Tables:
    """The substring tables of a shard of codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        m = max(1, round(bits / np.clip(round(np.log2(max(len(codes), 2))), 4, 16)))
        cuts = np.linspace(0, bits, m + 1).astype(int)
        self.codes, self.shift, self.width = codes, cuts[:-1].tolist(), np.diff(cuts).tolist()
        self.order, self.start = [], []
        for t in range(m):
            value = self.substring(codes, t)
            self.order.append(np.argsort(value, kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.width[t]))]))

    def substring(self, codes: np.ndarray, t: int) -> np.ndarray:
        return (codes >> np.uint64(self.shift[t]) & np.uint64((1 << self.width[t]) - 1)).astype(np.int64)

    def probe(self, queries: np.ndarray, t: int, r: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, distance) of the codes whose substring t differs from the query's in exactly r bits and that no earlier probe reached."""
        masks = np.arange(1 << self.width[t])
        masks = masks[np.bitwise_count(masks) == r]
        if not len(masks):
            return
        step = max(1, PROBES // len(masks))
        for i in range(0, len(queries), step):
            value = self.substring(queries[i : i + step], t)[:, None] ^ masks
            low = self.start[t][value]
            count = self.start[t][value + 1] - low
            each = np.concatenate([[0], np.cumsum(count.sum(1))])
            for a, b in K.slices(each, PROBES):
                row = self.order[t][K.aranges(low[a:b].ravel(), count[a:b].ravel())]
                query = np.repeat(np.arange(i + a, i + b), np.diff(each[a : b + 1]))
                differs = queries[query] ^ self.codes[row]
                first = np.ones(len(row), bool)
                for other in range(len(self.width)):
                    if other != t:  # tables before this one are probed within r bits already, the others within r - 1
                        first &= np.bitwise_count(self.substring(differs, other)) > (r if other < t else r - 1)
                row, query, differs = row[first], query[first], differs[first]
                yield query, row, np.bitwise_count(differs).astype(np.int64)


class Nearest:
    """The k nearest of each query of one length so far, over the shards that it has been compared with."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, bits: int, margin: float):
        self.rows, self.codes, self.k, self.bits, self.margin = rows, codes, k, bits, margin
        self.vectors = scaled(vectors)
        self.norm = np.sqrt((self.vectors**2).sum(1))
        self.found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # query, cosine, number, missing, row
        self.least = np.full(len(rows), -np.inf)  # the k-th cosine
        self.radius = np.full(len(rows), bits)

    def merge(self, *new: np.ndarray) -> None:
        every = [np.concatenate(x) for x in zip(self.found, new, strict=True)]
        query, cosine, number, missing, row = every
        order = np.lexsort((row, number, missing, -cosine, query))
        q = query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.found = [x[order[place < self.k]] for x in every]
        full = order[place == self.k - 1]
        self.least[query[full]] = cosine[full]
        self.radius[query[full]] = radius(cosine[full], self.bits, self.margin)

    def search(self, rows: np.ndarray, number: np.ndarray, missing: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> None:
        """Compares all queries with a shard."""
        tables = Tables(codes, self.bits)
        vectors = scaled(vectors)
        norm = np.sqrt((vectors**2).sum(1))
        m = len(tables.width)
        for r in range(max(tables.width) + 1):
            for t in range(m):
                live = np.flatnonzero(self.radius >= m * r + t)
                if not len(live):
                    return
                for query, row, distance in tables.probe(self.codes[live], t, r):
                    query = live[query]
                    near = (distance <= self.radius[query]) & (self.rows[query] != rows[row])
                    query, row = query[near], row[near]
                    for i in range(0, len(query), PAIRS):
                        q, x = query[i : i + PAIRS], row[i : i + PAIRS]
                        cosine = (self.vectors[q] * vectors[x]).sum(1) / (self.norm[q] * norm[x])
                        good = cosine >= self.least[q]
                        if good.any():
                            q, x = q[good], x[good]
                            self.merge(q, cosine[good], number[x], missing[x], rows[x])


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    x = lambda c: c.cast("double")
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of these rows, which are of one length."""
    starts = column.offsets.to_numpy()
    length = int(starts[rows[0] + 1] - starts[rows[0]])
    return column.values.to_numpy(zero_copy_only=False)[(starts[rows][:, None] + np.arange(length)).ravel()].reshape(len(rows), length)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    length = np.diff(column.offsets.to_numpy())
    for n in np.unique(length):
        yield np.flatnonzero(length == n)


def _coded(batches: Iterator[pa.RecordBatch], rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = np.zeros(batch.num_rows, np.uint64)
        for rows in _by_length(batch.column(2)):
            code[rows] = codes_of(scaled(_matrix(batch.column(2), rows)), rotation)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], ["row", "number", "vector", "code"])


@dataclass
class Index:
    """The table (row, number, vector, code); ids: (number, id) where ids aren't integers."""

    rows: DataFrame
    bits: int
    ids: DataFrame | None = None


def build(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> Index:
    spark = df.sparkSession
    bounded_batches(spark)
    assert 0 < bits <= 64
    whole = dict(df.dtypes)[id_col] in INTEGERS
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    rows = rows.withColumn("number", F.col("id").cast("bigint")) if whole else numbered(rows, "id", "number")
    ids = None if whole else written(rows.select("number", "id").distinct(), "ids")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    parts = max(1, n // SHARD_ROWS, min(2 * spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    plain = written(rows.select("number", "vector").repartition(parts).select(F.monotonically_increasing_id().alias("row"), "number", "vector"), "vectors")
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES * n // (8 * size)) / n) if n else 1.0
    sample = plain.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").toArrow().column(0).combine_chunks()
    alike = max(_by_length(sample), key=len, default=np.zeros(0, np.int64))
    unit = scaled(_matrix(sample, alike)) if len(alike) else np.zeros((0, 1))
    rotation = learned(unit / np.sqrt((unit**2).sum(1, keepdims=True)), bits)
    made = written(plain.mapInArrow(lambda x: _coded(x, rotation), "row bigint, number bigint, vector array<double>, code bigint"), "codes")
    discard(plain)
    return Index(made, bits, ids)


def _searched(batches: Iterator[pa.RecordBatch], queries: list[tuple], k: int, bits: int, margin: float) -> Iterator[pa.RecordBatch]:
    """The rows of a task, shard by shard, to (query, row, number, cosine) of the k nearest of each query among them."""
    best = {v.shape[1]: Nearest(row, v, code, k, bits, margin) for row, v, code in queries}
    held: dict[int, list[tuple]] = {n: [] for n in best}

    def flush(n: int) -> None:
        if held[n]:
            best[n].search(*(np.concatenate(x) for x in zip(*held[n], strict=True)))
            held[n] = []

    for batch in batches:
        row, code = batch.column(0).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
        missing, number = np.asarray(batch.column(1).is_null()), batch.column(1).fill_null(0).to_numpy()
        for some in _by_length(batch.column(2)):
            vectors = _matrix(batch.column(2), some)
            n = vectors.shape[1]
            if n in best:
                held[n].append((row[some], number[some], missing[some], code[some], vectors))
                if sum(len(x[0]) for x in held[n]) >= SHARD_ROWS:
                    flush(n)
    for n, b in best.items():
        flush(n)
        query, cosine, number, missing, row = b.found
        yield pa.RecordBatch.from_arrays([pa.array(b.rows[query]), pa.array(row), pa.array(number, mask=missing), pa.array(cosine)], ["query", "row", "number", "score"])


def search(index: Index, queries: Column, k: int = NEAREST, *, margin: float = MARGIN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row of the index that `queries`, a condition on its number, holds for."""
    out, bits = None, index.bits
    chosen = index.rows.where(queries).select("row", "number", "vector", "code")
    for block in in_blocks(chosen, F.size("vector") * 8, QUERY_BYTES):
        lengths: dict[int, list] = {}
        for r in block:
            lengths.setdefault(len(r.vector), []).append(r)
        packed = [(np.array([r.row for r in x], np.int64), np.array([r.vector for r in x]), np.array([r.code for r in x], np.int64).view(np.uint64)) for x in lengths.values()]
        shared = index.rows.sparkSession.sparkContext.broadcast(packed)
        found = index.rows.mapInArrow(lambda x, q=shared: _searched(x, q.value, k, bits, margin), "query bigint, row bigint, number bigint, score double")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("number"), "row"))).where(F.col("rank") <= k)
        names = F.broadcast(index.rows.sparkSession.createDataFrame([(r.row, r.number) for r in block], "q__ bigint, query_number bigint"))  # of one block
        found = found.join(names, F.col("query") == F.col("q__")).select("query_number", "rank", "number", "score")
        out = found if out is None else out.unionAll(found)
    if index.ids is None:
        return out.select(F.col("query_number").alias("query_id"), "rank", F.col("number").alias("vec_id"), "score")
    for name, column in (("query_id", "query_number"), ("vec_id", "number")):
        ids = index.ids.select(F.col("number").alias("n__"), F.col("id").alias(name))
        out = out.join(ids, F.col(column) == F.col("n__"), "left").drop("n__")
    return out.select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "embeddings"))
    found = written(search(index, F.col("number") % 50 == 0), "neighbours")
    discard(index.rows)
    return found

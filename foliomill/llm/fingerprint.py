"""Document fingerprints from prefix polynomial hashes.

The code points c_i of a text have the prefix sums S_k = sum(c_i * B**i for i < k) modulo 2**31 - 1, for two bases. Two array
look-ups give the hash of any span, equal spans are recognised whatever their position, and the longest common extension
of two positions is found by binary search. A fingerprint holds the length, the hash of the whole text, the MINIMA
smallest distinct hashes of its spans of WINDOW code points, and the hashes of prefixes and suffixes whose lengths grow by
sqrt(2). The likeness of two fingerprints is 1 for equal texts, and otherwise the larger of the estimated share of common
spans and the share of the longer text that the longest common prefix and suffix make up. Where the prefix arrays of both texts are at hand, as in
the query, these extensions are located exactly; from two stored fingerprints alone, on the grid of lengths.

Edge cases: null is the empty text; two empty texts have likeness 1, an empty and another 0; a text shorter than a window is
one span; repeated ids are ordered by a hash of the text and then the text; a single document is its own next;
ids that aren't integers are numbered in their order first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, with_ranges
from .session import bounded_batches, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245 % PRIME, 1_812_433_253 % PRIME)
WINDOW, MINIMA = 12, 32
#: Code points hashed at once, and bytes of text in one range of ids.
PIECE, BUCKET_BYTES = 1 << 18, 4 << 20
#: Ranges whose tops are broadcast, at most; those of more are joined.
MOST_SHARED = 200_000
U = np.uint64
_P, _S = U(PRIME), U(31)


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


def _table(base: int) -> np.ndarray:
    out = np.ones(1, U)
    step = base
    while len(out) < PIECE + 1:
        out = np.concatenate([out, fold(out * U(step))])
        step = step * step % PRIME
    return out


_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Powers of both bases, and of the inverse of the first."""
    if not _tables:
        _tables.extend(_table(b) for b in (*BASES, pow(BASES[0], -1, PRIME)))
    return _tables


class PrefixHashes:
    """Prefix arrays of a text for both bases. They answer span equality in O(1) and longest common extensions in O(log n)."""

    def __init__(self, points: np.ndarray):
        n = self.n = len(points)
        self.sums = [np.zeros(n + 1, np.uint32) for _ in BASES]
        for base, power, sums in zip(BASES, tables(), self.sums, strict=False):
            for i in range(0, n, PIECE):
                part = points[i : i + PIECE].astype(U) + U(1)
                s = fold(np.cumsum(fold(part * power[: len(part)])))
                if i:
                    s = fold(s * U(pow(base, i, PRIME))) + U(sums[i])
                    s = np.where(s >= _P, s - _P, s)
                sums[i + 1 : i + 1 + len(part)] = s

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the span [i, j), whatever its position."""
        return tuple((int(s[j]) - int(s[i])) * pow(b, -i, PRIME) % PRIME for s, b in zip(self.sums, BASES, strict=True))

    def extension(self, i: int, other: PrefixHashes, j: int, *, back: bool = False) -> int:
        """The length of the longest common extension of position i here and j there, to the right or, with `back`, to the left, by binary search.

        Spans that begin j - i apart differ by one power of the base, whatever their length.
        """
        low, high = 0, min(i, j) if back else min(self.n - i, other.n - j)
        sides = [(a.item(i), a, b.item(j), b, pow(base, max(j - i, 0), PRIME), pow(base, max(i - j, 0), PRIME)) for a, b, base in zip(self.sums, other.sums, BASES, strict=True)]
        sign = -1 if back else 1
        while low < high:
            mid = (low + high + 1) // 2
            x, y = i + sign * mid, j + sign * mid
            same = all(((a.item(x) - ai) * u - (b.item(y) - bj) * v) % PRIME == 0 for ai, a, bj, b, u, v in sides)
            low, high = (mid, high) if same else (low, mid - 1)
        return low

    def windows(self, w: int) -> np.ndarray:
        """The hashes of all spans of w code points by the first base."""
        s, inverse = self.sums[0], tables()[2]
        out = []
        for i in range(0, self.n - w + 1, PIECE):
            m = min(PIECE, self.n - w + 1 - i)
            d = fold(s[i + w : i + w + m].astype(U) + _P - s[i : i + m])
            d = fold(d * inverse[:m])
            out.append(fold(d * U(pow(BASES[0], -i, PRIME))) if i else d)
        return np.concatenate(out) if out else np.zeros(0, U)


_grids: list[int] = []


def grid(n: int) -> np.ndarray:
    if not _grids:
        _grids.extend(sorted({int(2 ** (k / 2)) for k in range(80)}))
    return np.array(_grids[: int(np.searchsorted(_grids, n, "right"))], np.int64)


def hashed(text: str | None) -> PrefixHashes:
    return PrefixHashes(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))


def fingerprint(text: str | PrefixHashes | None) -> tuple:
    """(n, hash, minima, prefixes, suffixes); encoded() makes a string of it."""
    h = text if isinstance(text, PrefixHashes) else hashed(text)
    n = h.n
    if not n:
        none = np.zeros(0, np.uint32)
        return 0, 0, none, none.astype(np.uint16), none.astype(np.uint16)
    v = (h.windows(min(WINDOW, n)) * U(2654435761)) & U(0xFFFFFFFF)
    if len(v) > 8 * MINIMA:
        small = np.unique(np.partition(v, 4 * MINIMA)[: 4 * MINIMA])
        v = small if len(small) >= MINIMA else np.unique(v)
    else:
        v = np.unique(v)
    minima = v[:MINIMA].astype(np.uint32)
    a, b = (x.astype(U) for x in h.sums)
    g = grid(n)
    prefixes = ((a[g] ^ (b[g] << U(5))) * U(0x9E3779B97F4A7C15) >> U(48)).astype(np.uint16)
    back = [pow(BASES[0], -(n - int(k)), PRIME) for k in g]
    suffix = fold(fold(a[n] + _P - a[n - g]) * np.array(back, U))
    suffixes = (suffix * U(0x9E3779B97F4A7C15) >> U(48)).astype(np.uint16)
    return n, int(a[n]) << 31 | int(b[n]), minima, prefixes, suffixes


def encoded(f: tuple) -> str:
    return f"{f[0]:x}.{f[1]:016x}.{f[2].astype('>u4').tobytes().hex()}.{f[3].astype('>u2').tobytes().hex()}.{f[4].astype('>u2').tobytes().hex()}"


def decoded(text: str) -> tuple:
    n, h, *arrays = text.split(".")
    return int(n, 16), int(h, 16), *(np.frombuffer(bytes.fromhex(a), t).astype(t[1:]) for a, t in zip(arrays, (">u4", ">u2", ">u2"), strict=True))


def _common(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> int:
    """The longest grid length at which both agree, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return int(lengths[low - 1]) if low else 0


def likeness(a: tuple, b: tuple, arrays: tuple[PrefixHashes, PrefixHashes] | None = None) -> float:
    """0 to 1; 1 for equal texts. With the prefix arrays of both texts the common prefix and suffix are exact, without them the longest on the grid."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    both = np.intersect1d(a[2], b[2], assume_unique=True)
    least = np.union1d(a[2], b[2])[: max(min(len(a[2]), len(b[2])), 1) if max(len(a[2]), len(b[2])) == MINIMA else None]
    spans = np.isin(both, least).sum() / len(least)
    if arrays:
        x, y = arrays
        ends = x.extension(0, y, 0) + x.extension(x.n, y, y.n, back=True)
    else:
        g = grid(min(a[0], b[0]))
        ends = _common(a[3], b[3], g) + _common(a[4], b[4], g)
    return float(min(max(spans, min(ends, a[0], b[0]) / max(a[0], b[0])), 1.0))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, halo, doc_id, text) in order; a row's next is the following one, and halo rows are only that."""
    kept: tuple | None = None
    rows: list[tuple] = []

    def answer(doc, text, arrays, mark, after, after_arrays, after_mark) -> tuple:
        new = edited(text, after)
        new_arrays = arrays if new == text else hashed(new)
        new_mark = mark if new == text else fingerprint(new_arrays)
        near = likeness(mark, new_mark, (arrays, new_arrays)), likeness(mark, after_mark, (arrays, after_arrays))
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(mark), encoded(new_mark), *near

    def out() -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        id_type = batch.schema.field(2).type
        for bucket, halo, doc, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if halo and (kept is None or kept[0] != bucket):
                continue  # a second row with the id that closes the bucket
            text = text or ""
            arrays = hashed(text)
            mark = fingerprint(arrays)
            if kept and kept[0] == bucket:
                rows.append(answer(*kept[1:], text, arrays, mark))
            kept = None if halo else (bucket, doc, text, arrays, mark)
        if rows:
            yield out()
            rows.clear()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; see op1 in the README for the columns.

    Rows are dealt by ranges of the id, each with the first row of the range below it, so that every text moves once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "number")
    rows, n = with_ranges(rows, "number", "text", BUCKET_BYTES, "bucket")
    # the first row of each bucket follows the last one of the bucket above, and the very first follows the very last
    in_order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    tops = rows.groupBy("bucket").agg(F.max("number").alias("top"))
    to = tops.select(F.col("bucket").alias("its"), "top", F.coalesce(F.lead("bucket").over(in_order), F.min("bucket").over(in_order)).alias("to"))
    rows = rows.join(F.broadcast(to) if n <= MOST_SHARED else to, F.col("bucket") == F.col("its"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("halo"))
    also = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("halo"))
    rows = rows.select(F.explode(F.when(F.col("number").eqNullSafe(F.col("top")), F.array(own, also)).otherwise(F.array(own))).alias("at"), "doc_id", "text", "number")
    rows = rows.select("at.bucket", "at.halo", "doc_id", "text", "number")
    tasks = max(1, -(-n // 4))
    dealt = rows.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket", "halo", F.col("number").desc_nulls_last(), F.xxhash64("text"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return dealt.mapInArrow(_compared, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

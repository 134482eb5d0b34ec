"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs. A trigram is bound as rho(rho(a)) * rho(b) * c, where rho rotates a
vector by one; a text is the bundle (sum) of its trigrams, a language the bundle of its texts' unit vectors. The language of
a text is the prototype with the largest cosine, and the score its share in a softmax of the cosines.

Letters are taken without case; everything else is one space between words. The prototypes are learned from a bounded sample
of about SAMPLE labelled texts, chosen by a hash of the id; every text is classified whole.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned; ties go
to the smaller name; rows without a language are classified but not learned from, nor are rows without an id, whose held_out is null; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, table

DIMENSIONS, SYMBOLS, SAMPLE, SHARPNESS = 1024, 128, 20_000, 25.0
#: Code points worked on at once.
PIECE = 1 << 18
#: Code points beyond the table that are letters: the ideographs of the supplementary planes, which count as one letter.
WIDE = (0x20000, 0x323B0)

_letters: list[np.ndarray] = []
_bound: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (0: not in a word), and whether it is a letter."""
    if not _letters:
        n = 0x20000
        symbol, letter = np.zeros(n, np.uint8), np.zeros(n, bool)
        for cp in range(n):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LM":
                low = ord(chr(cp).lower()[0])
                symbol[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
                letter[cp] = kind == "L"
        _letters.extend([symbol, letter])
    return _letters[0], _letters[1]


def bound_vectors() -> list[np.ndarray]:
    """The letters' sign vectors, rotated twice, once and not at all."""
    if not _bound:
        base = np.random.Generator(np.random.PCG64(4)).integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * np.int8(2) - np.int8(1)
        _bound.extend([np.roll(base, 2, 1), np.roll(base, 1, 1), base])
    return _bound


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text (float32) and whether it has a letter."""
    symbol, letter = letter_tables()
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    known = np.zeros(len(texts), bool)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        codes, counts, rows = [], [], []
        for k, s in zip(owner, held, strict=True):
            tri = (s[:-2].astype(np.int32) * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            u, c = np.unique(tri, return_counts=True)
            codes.append(u)
            counts.append(c)
            rows.append(np.full(len(u), k))
        code, count, row = np.concatenate(codes), np.concatenate(counts), np.concatenate(rows)
        u, at = np.unique(code, return_inverse=True)
        first, local = np.unique(row, return_inverse=True)
        a, b, c = bound_vectors()
        for i in range(0, len(u), 4096):
            part = u[i : i + 4096]
            grams = (a[part // (SYMBOLS * SYMBOLS)] * b[part // SYMBOLS % SYMBOLS] * c[part % SYMBOLS]).astype(np.float32)
            here = (at >= i) & (at < i + 4096)
            dense = np.bincount(local[here] * len(part) + at[here] - i, count[here], len(first) * len(part)).reshape(len(first), len(part)).astype(np.float32)
            out[first] += dense @ grams
        held.clear()
        owner.clear()
        size = 0

    for k, text in enumerate(texts):
        # The symbols of the whole text, one byte each; trigrams are then counted piece by piece, each once.
        parts = [np.zeros(1, np.uint8)]
        for i in range(0, len(text or ""), PIECE):
            points = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.where(points < len(symbol), points, np.where((points >= WIDE[0]) & (points < WIDE[1]), 0x4E00, 0))
            known[k] |= bool(letter[points].any())
            parts.append(symbol[points])
        s = np.concatenate([*parts, np.zeros(1, np.uint8)])
        s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
        for i in range(0, len(s) - 2, PIECE):
            held.append(s[i : i + PIECE + 2])
            owner.append(k)
            size += len(held[-1])
            if size >= PIECE:
                flush()
    flush()
    return out, known


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        vectors, known = profiles(batch.column(1).to_pylist())
        vectors = _unit(vectors)
        for k in np.flatnonzero(known):
            sums[names[k]] = sums.get(names[k], 0) + vectors[k].astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "vector"])


def learned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes, from about `sample` of the rows that have a language."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull())
    n = known.select(F.lit(1)).count()
    share = min(1.0, sample / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) if share < 1 else 1 << 20))
    got = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_bundled, "lang string, vector binary").collect()
    sums: dict[str, np.ndarray] = {}
    for name, vector in sorted((r[0], bytes(r[1])) for r in got):
        sums[name] = sums.get(name, 0) + np.frombuffer(vector)
    names = sorted(sums)
    mean = sum(_unit(sums[k]) for k in names) / max(len(names), 1) if len(names) > 1 else 0
    return names, np.array([_unit(_unit(sums[k]) - mean) for k in names], np.float32).reshape(len(names), DIMENSIONS)


def classified(batches: Iterator[pa.RecordBatch], names: list[str], prototypes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, known = profiles(batch.column(1).to_pylist())
        if names:
            cosine = _unit(vectors) @ prototypes.T
            best = cosine.argmax(1)
            e = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
            score = (e / e.sum(1, keepdims=True))[np.arange(len(best)), best].astype(float)
        else:
            best, score, known = np.zeros(len(known), int), np.zeros(len(known)), known & False
        pred = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda x: classified(x, *shared.value), f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learned(docs.where(~fold))
    return identify(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")

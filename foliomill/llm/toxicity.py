"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed features: the distinct lower-cased words of a text and the leading bytes of each (LEADS),
every feature counted once per distinct word. Fitting adds to the likelihood, for every labelled text, the squared changes of
its logit under MOVES counterfactual edits: its identity terms are swapped for others and taken out; a text that mentions none
gets one term, and that term swapped for another. So a group's mention on its own moves no score, neither by a weight of the term nor by one of a lead that it
shares with other words. The loss also has an L1 term, which leaves few weights.

The labelled texts are a bounded sample: the SAMPLE rows with the smallest hash of doc_id among texts of at most SAMPLE_BYTES bytes. Scoring reads whole texts, and
the weights (one array of WIDTH floats) are the only thing broadcast.

Edge cases: a null or empty text has no features and gets the score of the bias alone; without labels, or with one class
only, every score is the share of label 1 (0 without labels); a null label is no label; a row without an id is scored, has no label and a null held_out; repeated rows are each scored;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import bounded_batches, table

#: Features are hashed to this many weights; leads are in bytes; labelled rows that are fitted on, at most.
WIDTH, LEADS, SAMPLE = 1 << 18, (4, 5, 6, 7, 8), 5_000
#: Bytes of a text that is fitted on, at most, and counterfactual edits of each.
SAMPLE_BYTES, MOVES = 1 << 17, 2
#: L1 is in texts: a feature of so many texts, or fewer, hardly gets a weight, whatever the size of the sample.
STEPS, RATE, L1, L2, SWAP = 100, 0.08, 1.5, 1e-4, 1.0

# Terms that name a group, in the four languages of the corpus; fixed values.
IDENTITY = (
    "women men girls boys muslims christians jews hindus buddhists atheists black white asian latino arab african european "
    "american gay lesbian bisexual transgender straight immigrants refugees foreigners disabled blind deaf elderly young poor rich "
    "femmes hommes musulmans chrétiens juifs noirs blancs asiatiques arabes homosexuels immigrés réfugiés handicapés "
    "frauen männer muslime christen juden schwarze weiße asiaten araber homosexuelle einwanderer flüchtlinge behinderte "
    "mujeres hombres musulmanes cristianos judíos negros blancos asiáticos árabes homosexuales inmigrantes refugiados discapacitados"
).split()

IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x80:] = IS_LETTER[0x61:0x7B] = True
_VALUES = K.byte_values(10)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: each distinct word of a row gives its own feature and one for each of its leads."""
    data = K.lowered(data)
    starts, ends = K.words(data, bounds, IS_LETTER)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = K.span_hashes(data, starts, ends, _VALUES)
    row = np.searchsorted(bounds, starts, "right") - 1
    _, once = np.unique(whole + K.mix(row.astype(K.U64) + K.U64(1)), return_index=True)
    once.sort()
    starts, ends, row, whole = starts[once], ends[once], row[once], whole[once]
    rows, found = [row], [whole]
    for k in LEADS:
        long = ends - starts > k
        s = starts[long]
        lead = np.zeros(len(s), np.uint64)
        for i in range(k):
            lead = lead * K.U64(1099511628211) + _VALUES[data[s + i]]
        rows.append(row[long])
        found.append(K.mix(lead + K.U64(k)))
    return np.concatenate(rows), (np.concatenate(found) % K.U64(WIDTH)).astype(np.int64)


def term_features() -> list[np.ndarray]:
    out = []
    for t in IDENTITY:
        data = np.frombuffer(t.encode(), np.uint8)
        out.append(features(data, np.array([0, len(data)]))[1])
    return out


def fit(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, mentions: list[np.ndarray], *, steps: int = STEPS, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights and bias. row, feature: pairs over the labelled texts; mentions: indices of identity terms in each text."""
    n = len(labels)
    share = float(labels.mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return np.zeros(WIDTH, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    terms = term_features()
    change_row, change_feature, change_sign = [], [], []
    for i, has in enumerate(mentions):
        away, other = [(t, -1.0) for t in has], [((int(t) + 1 + i) % len(terms), 1.0) for t in has]
        one, two = (i % len(terms), 1.0), ((i * 7 + 3) % len(terms), -1.0)
        edits = [away + other, away] if len(has) else [[one], [one, two]]
        for t, sign, move in [(*x, MOVES * i + k) for k, edit in enumerate(edits) for x in edit]:
            change_row += [move] * len(terms[t])
            change_feature += terms[t].tolist()
            change_sign += [sign] * len(terms[t])
    # Features of a single text get no weight; the others, and those of the terms, are numbered anew.
    seen = np.bincount(feature, minlength=WIDTH)
    frequent = seen >= 2
    keep = frequent[feature]
    row, feature = row[keep].astype(np.int32), feature[keep].astype(np.int32)
    cf = np.array(change_feature, np.int64)
    known = frequent.copy()
    known[cf] = True
    used = np.flatnonzero(known)
    number = np.zeros(WIDTH, np.int32)
    number[used] = np.arange(len(used))
    f, cf = number[feature], number[cf]
    del feature, keep
    cr, cs = np.array(change_row), np.array(change_sign)
    rare = ~frequent[used]
    rare[cf] = False  # the features of terms stay live, whatever texts they are in
    w, b = np.zeros(len(used), np.float32), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    weight /= weight.mean()
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(row, w[f], n), -50, 50)
        error = (weight * (1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        g = np.bincount(f, error[row], len(used)) + L2 * w
        moved = np.bincount(cr, w[cf] * cs, MOVES * n)
        g += np.bincount(cf, 2 * swap * moved[cr] * cs / n, len(used))
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / c2) + 1e-6)
        w -= scale * m / c1
        w = (np.sign(w) * np.maximum(0, np.abs(w) - scale * (L1 / n))).astype(np.float32)
        w[rare] = 0
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    out = np.zeros(WIDTH, np.float32)
    out[used] = w
    return out, b


def scores(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, name: str = "score") -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the text get their other columns and a score."""
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(batch.num_columns - 1))
        z = np.full(batch.num_rows, bias)
        for i, j in K.slices(offsets):
            row, feature = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            z[i:j] += np.bincount(row, weights[feature], j - i)
        score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        names = [*batch.schema.names[:-1], name]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, features, mentioned identity terms)."""
    terms = {x.encode(): k for k, x in enumerate(IDENTITY)}
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(2))
        found, mentions = [], []
        for i, j in K.slices(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, feature = features(part, bounds)
            order = np.lexsort((feature, row))
            row, feature = row[order], feature[order]
            cut = np.searchsorted(row, np.arange(j - i + 1))
            found += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            low = K.lowered(part)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                one = low[a:b]
                s, e = K.words(one, np.array([0, len(one)]), IS_LETTER)
                raw = one.tobytes()
                mentions.append(sorted({terms[x] for x in {raw[p:q] for p, q in zip(s.tolist(), e.tolist(), strict=True) if q - p <= 20} if x in terms}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(mentions, pa.list_(pa.int32()))], ["id", "label", "features", "mentions"])


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Fits on at most `sample` labelled rows, those with the smallest hash of the id; texts of more than `sample_bytes` bytes are left out of it."""
    bounded_batches(docs.sparkSession)
    few = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    kind = dict(texts.dtypes)["id"]
    got = texts.join(F.broadcast(few), "id").orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(sample)  # rows that share an id
    got = got.select("id", "label", "text").mapInArrow(_gathered, f"id {kind}, label int, features binary, mentions array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda k, a=got.column("id").to_pylist(), f=got.column("features").to_pylist(): (a[k], f[k]))
    got = got.take(pa.array(order, pa.int64()))
    each = [np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()]
    row = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    feature = np.concatenate(each) if each else np.zeros(0, np.int32)
    return fit(got.column("label").to_numpy().astype(int), row, feature, got.column("mentions").to_pylist())


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns `keep` of every row and its score, which needs a name that none of them has."""
    if score_col in keep:
        raise ValueError(f"{score_col} is a column already; name another score_col")
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col(text_col).alias("text__scored")).mapInArrow(lambda x: scores(x, *shared.value, score_col), ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{score_col}` double")


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels").where(_fold(5) != 0))
    return scored(docs, model, keep=["doc_id"]).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

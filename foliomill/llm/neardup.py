"""Near-duplicate detection with SetSketch registers.

1. Every text gets its set of distinct shingles and a SetSketch of it: REGISTERS truncated minima on an exponential scale
   (base B, so a register is floor(1 - log_B h)). Texts with equal sets are one class, with the smallest id as its node.
2. Bands of ROWS register values are hashed. Nodes that share a value are linked if their marks, the lowest bits of all registers, differ in NEAR
   bits at most, so that chance collisions of unlike texts don't grow into one family. Of each band value a task sends on no node that is within
   SAME bits of another that it sends; so a value that a third of the corpus has makes a few rows in each task. What is linked is one family.
3. The sets of a family meet in one task, or, if it has more than CHUNK nodes, chunk by chunk: each chunk with the first one, so that a set
   is sent twice on average whatever the size of the family. There the joint likelihood of the
   registers drops pairs whose most likely similarity is below DOUBT, and every other pair is confirmed on the full sets.
4. Confirmed links make components; a task gives a spanning forest of its links, not all pairs. If a family of three chunks or more is in several components then,
   the nodes outside its largest one are compared with all of its nodes. Pairs inside the largest one are linked already, so nothing is lost.

Two texts of similarity 0.75 share no band with probability about 1e-6. Their marks differ in 20 bits of 160 on average, with a standard deviation of 4.2,
so NEAR is five of these off; for texts of similarity 0.3 it is 2.5 of theirs on the other side. A node that isn't sent on is represented by one of similarity 0.6 or more,
and has other bands (15 of 64 are shared at 0.75) where it meets its partners by itself. The likelihood estimates the similarity with a standard deviation of 0.034, so
DOUBT is seven of these below 0.75; nothing else loses a link.

Edge cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing; a text of fewer words than a shingle has
one, the whole; repeated rows are one class; rows that share an id are one node; a row without an id is its own
component, null, and kept; ids that aren't integers are numbered in their order first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components, forest
from .ranges import INTEGERS, numbered
from .session import bounded_batches, discard, table, tidied, written

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
REGISTERS, BANDS, ROWS, B, RATE, TOP = 160, 64, 5, 1.001, 20.0, 65_535
#: Nodes of a family that are compared in one task, the similarity below which the sketches rule a pair out, and bytes of band values in a part.
CHUNK, DOUBT, PART_BYTES = 128, 0.5, 8 << 20
#: Differing bits of two marks of REGISTERS bits, up to which nodes of a band value are linked, and up to which one stands for the other.
NEAR, SAME = 41, 32
U = np.uint64

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
SEED = 8
_random = np.random.Generator(np.random.PCG64(88))
_ODD = _random.integers(1, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_FLIP = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64)
#: The registers of each band: REGISTERS in random order, again and again, cut into ROWS.
_BAND = np.concatenate([_random.permutation(REGISTERS) for _ in range(-(-BANDS * ROWS // REGISTERS))])[: BANDS * ROWS].reshape(BANDS, ROWS)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = K.lowered(data)
    starts, ends = K.words(data, bounds, IS_WORD)
    h = K.word_hashes(data, starts, ends, SEED)
    n = len(h)
    rolled = np.zeros(max(n - words + 1, 0), U)
    for i in range(words):
        rolled = rolled * U(0x9FB21C651E98DF25) + h[i : n - words + 1 + i] if n >= words else rolled
    rolled = K.mix(rolled) if n >= words else rolled
    first = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = U(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * U(0x9FB21C651E98DF25) + x
            out.append(K.mix(np.array([one], U) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, a row for each non-empty set. Merging two sketches is their maximum."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), U)
    buffer = np.empty_like(flat)
    for i in range(REGISTERS):
        np.bitwise_xor(flat, _FLIP[i], out=buffer)
        np.multiply(buffer, _ODD[i], out=buffer)
        least[:, i] = np.minimum.reduceat(buffer, at)
    u = ((least >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def band_values(registers: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of the bands."""
    out = np.zeros((len(registers), BANDS), U)
    for k in range(ROWS):
        out = out * U(0x9FB21C651E98DF25) + registers[:, _BAND[:, k]].astype(U) + U(1)
    return K.mix(out + np.arange(BANDS, dtype=U) * U(0xD6E8FEB86659FD93))


def marks_of(registers: np.ndarray) -> np.ndarray:
    """The lowest bit of each register, packed: (rows, words) of uint32. Registers that differ have equal bits half of the time."""
    return np.ascontiguousarray(np.packbits((registers & 1).astype(np.uint8), axis=1)).view(np.uint32)


def linked(value: np.ndarray, node: np.ndarray, marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by value and node; at: the row of marks of each. Edges (2, n) that connect what steps of NEAR bits connect among the rows of a
    value, and the mask of the rows that others stand for.

    All values are walked at once: in each round one row of each value is compared with those that nothing has reached yet.
    """
    gone = np.zeros(len(value), bool)
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else gone
    rows = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    group = np.cumsum(new)
    reached = np.zeros(len(value), bool)
    edges = [np.zeros((2, 0), np.int64)]
    while len(rows):
        g = group[rows]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        # a row that is reached but not compared yet, if there is one, or else the first
        first = np.minimum.reduceat(np.where(reached[rows], 0, len(rows)) + np.arange(len(rows)), starts) % len(rows)
        source = rows[np.repeat(first, sizes)]
        bits = np.bitwise_count(marks[at[rows]] ^ marks[at[source]]).sum(1, dtype=np.int64)
        hit = ~reached[rows] & (bits <= NEAR) & (rows != source)
        edge = np.stack([node[rows[hit]], node[source[hit]]])
        edges.append(edge[:, edge[0] != edge[1]])
        gone[rows[hit & (bits <= SAME) & ~gone[source]]] = True
        reached[rows[hit]] = True
        open_ = ~reached[rows]
        open_[first] = False
        more = np.repeat(np.add.reduceat(open_, starts) > 0, sizes)
        more[first] = False
        rows = rows[more]
    return np.unique(np.concatenate(edges, axis=1), axis=1), gone


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, j: float = DOUBT) -> np.ndarray:
    """Whether the most likely similarity of each pair (rows of a by rows of b) is at least j: the sign of the slope of the joint
    log-likelihood of the registers at j, which is concave. na, nb: the known sizes of the sets."""
    more = np.zeros((len(a), len(b)))
    less = np.zeros((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, len(b) * REGISTERS))
    for i in range(0, len(a), step):
        x, y = a[i : i + step, None, :], b[None, :, :]
        more[i : i + step] = (x > y).sum(2)
        less[i : i + step] = (x < y).sum(2)
    u = na[:, None] / (na[:, None] + nb[None, :])
    v = 1 - u
    c = (B - 1) / B

    def p(x):
        return -np.log1p(-x * c) / np.log(B)

    def slope(x):
        return c / np.log(B) / (1 - x * c)

    x1, x2 = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    same = REGISTERS - more - less
    d = -more * v * slope(x1) / p(x1) - less * u * slope(x2) / p(x2) + same * (v * slope(x1) + u * slope(x2)) / np.maximum(1 - p(x1) - p(x2), 1e-9)
    return (d >= 0) & (np.minimum(u, v) > j * np.maximum(u, v))


def common_counts(sets: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[at] > 1
    at, row = at[shared], row[shared]
    out = np.zeros((n, n))
    if len(at):
        _, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for i in range(0, int(at[-1]) + 1, columns):
            a, b = np.searchsorted(at, [i, i + columns])
            dense = np.zeros((n, min(columns, int(at[-1]) + 1 - i)), np.float32)
            dense[row[a:b], at[a:b] - i] = 1
            out += dense @ dense.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def confirmed(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of one side (all equal) or between sides 0 and 1."""
    n = np.array([len(s) for s in sets], float)
    pair = likely(registers, registers, n, n)
    pair &= ~np.eye(len(nodes), dtype=bool)
    if (side != side[0]).any():
        pair &= side[:, None] != side[None, :]
    keep = np.flatnonzero(pair.any(1))
    if not len(keep):
        return nodes[:0], nodes[:0]
    common = common_counts([sets[k] for k in keep])
    union = n[keep][:, None] + n[keep][None, :] - common
    link = pair[np.ix_(keep, keep)] & (DENOMINATOR * common >= NUMERATOR * union)
    a, b = np.nonzero(np.triu(link))
    return forest(nodes[keep][a], nodes[keep][b])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(1))
        n = np.zeros(batch.num_rows, np.int64)
        k1, k2 = np.zeros(batch.num_rows, U), np.zeros(batch.num_rows, U)
        found: list[bytes | None] = [None] * batch.num_rows
        for i, j in K.slices(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            full = [k for k, s in enumerate(sets) if len(s)]
            some = [sets[k] for k in full]
            n[i:j] = [len(s) for s in sets]
            if some:
                flat = np.concatenate(some)
                at = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
                k1[np.array(full) + i] = np.add.reduceat(K.mix(flat ^ U(0xA5A5A5A5A5A5A5A5)), at)
                k2[np.array(full) + i] = np.add.reduceat(K.mix(flat + U(0x1234567812345678)), at)
                for k, r in zip(full, sketches(some), strict=True):
                    found[i + k] = r.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(found, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "registers"])


def _band_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Classes to blobs of (band values, nodes, marks) by part; edges found in the task have part -1."""
    kinds = pa.schema([("part", pa.int32()), ("values", pa.binary()), ("nodes", pa.binary()), ("marks", pa.binary())])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        value, nodes, marks = (np.concatenate([h[k] for h in held]) for k in range(3))
        at = np.repeat(np.arange(len(nodes)), BANDS)
        order = np.lexsort((nodes[at], value))
        value, at = value[order], at[order]
        edges, gone = linked(value, nodes[at], marks, at)
        value, at = value[~gone], at[~gone]
        part = (value >> U(40)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        part, value, at = part[order], value[order], at[order]
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        rows = [{"part": int(part[a]), "values": value[a:b].tobytes(), "nodes": nodes[at[a:b]].tobytes(), "marks": marks[at[a:b]].tobytes()} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if edges.shape[1]:
            rows.append({"part": -1, "values": edges[0].tobytes(), "nodes": edges[1].tobytes(), "marks": b""})
        held.clear()
        return pa.RecordBatch.from_pylist(rows, kinds)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        values = band_values(registers)
        held.append((values.ravel(), batch.column(0).to_numpy(), marks_of(registers)))
        size += values.size
        if size > 1_000_000:
            yield flush()
            size = 0
    if held:
        yield flush()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs ordered by part to the edges among the nodes of each band value."""
    values: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    part = None

    def flush() -> Iterator[pa.RecordBatch]:
        if not values:
            return
        v, n, m = np.concatenate(values), np.concatenate(nodes), np.concatenate(marks)
        for held in (values, nodes, marks):
            held.clear()
        order = np.lexsort((n, v))
        e, _ = linked(v[order], n[order], m, order)
        if e.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

    for batch in batches:
        for p, v, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p == -1:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["a", "b"])
                continue
            if p != part:
                yield from flush()
                part = p
            values.append(np.frombuffer(v, U))
            nodes.append(np.frombuffer(n, np.int64))
            marks.append(np.frombuffer(m, np.uint32).reshape(len(nodes[-1]), -1))
    yield from flush()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(batch.num_columns - 1))
        found = []
        for i, j in K.slices(offsets):
            found += [s.tobytes() for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "shingles"])


def _compared(key: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by("node")
    sets = [np.frombuffer(x, U) for x in group.column("shingles").to_pylist()]
    full = [k for k, s in enumerate(sets) if len(s)]
    group = group.take(pa.array(full, pa.int64()))
    sets = [sets[k] for k in full]
    if len(sets) < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    nodes = group.column("node").to_numpy()
    side = (group.column("chunk").to_numpy() != key[1].as_py()).astype(np.int8)
    registers = sketches(sets)
    a, b = confirmed(nodes, side, sets, registers)
    return pa.table({"a": a, "b": b})


def families(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): edges between nodes that share a band value and have marks within NEAR bits, or a chain of such nodes. n: the number of classes."""
    parts = max(64, -(-n * BANDS * (16 + REGISTERS // 8) // PART_BYTES))
    blobs = classes.select("node", "registers").mapInArrow(tidied(lambda x: _band_rows(x, parts)), "part int, values binary, nodes binary, marks binary")
    spread = F.when(F.col("part") < 0, -1 - F.pmod(F.hash("values"), F.lit(parts))).otherwise(F.col("part"))
    return blobs.repartition(parts, spread).sortWithinPartitions("part").mapInArrow(tidied(_met), "a bigint, b bigint")


def _links(dealt: DataFrame, *, whole: bool) -> DataFrame:
    """Confirmed links (a, b) among the nodes of dealt (node, component, chunk, meets: the chunks to be compared with, shingles).

    whole: all nodes that are sent to a chunk are compared with each other; else those of one chunk with those of the other.
    """
    own = F.col("other") if whole else F.col("chunk")
    sent = dealt.withColumn("other", F.explode("meets"))
    sent = sent.select("component", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), own.alias("chunk"), "node", "shingles")
    return sent.groupBy("component", "low", "high").applyInArrow(_compared, "a bigint, b bigint")


def unsettled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, component, chunk, meets) of the families that links leave in several components. The nodes outside the largest component of a family
    come first in its chunks and meet all; those of the largest one meet only these."""
    found = linked.select(F.col("node").alias("x"), F.col("component").alias("y"))
    now = members.join(found, F.col("node") == F.col("x"), "left").select("node", "component", F.coalesce("y", "node").alias("y"))
    sizes = now.groupBy("component", "y").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("component").alias("f"))
    sizes = sizes.agg(F.max(F.struct("k", "y")).alias("top"), F.sum("k").alias("size")).where("size > top.k")
    rest, most = (F.ceil(x / CHUNK).cast("int") for x in (F.col("size") - F.col("top.k"), F.col("top.k")))
    now = now.join(sizes, F.col("component") == F.col("f")).withColumn("outside", F.col("y") != F.col("top.y"))
    chunk = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), rest)).otherwise(rest + F.pmod(F.xxhash64("node"), most)).cast("int")
    last = F.when(F.col("outside"), rest + most - 1).otherwise(rest - 1)
    return now.select("node", "component", chunk.alias("chunk"), F.sequence(F.lit(0), last).alias("meets"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    if kind not in INTEGERS:
        named = numbered(docs.select(F.col(id_col).alias("name__"), F.col(text_col).alias("text")), "name__", "doc_id")
        found = near_duplicates(named)
        names = named.where("doc_id is not null").select("doc_id", "name__").distinct()
        least = names.select(F.col("doc_id").alias("component_id"), F.col("name__").alias("component__"))
        found = found.join(names, "doc_id", "left").join(least, "component_id", "left")
        return found.select(F.col("name__").alias("doc_id"), "n_shingles", F.col("component__").alias("component_id"), "kept")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    described = written(rows.mapInArrow(tidied(_described), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, registers binary"), "sketches")
    known = described.where("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers")), "classes")
    n = classes.count()
    family = connected_components(families(classes, n), n)
    # the smallest node of a family is a member too
    members = family.unionAll(family.select(F.col("component").alias("node"), "component").distinct())
    sizes = family.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("size")).withColumnRenamed("component", "f")
    members = members.join(sizes, F.col("component") == F.col("f")).select("node", "component", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    members = written(members, "members")
    # texts move once: later comparisons of a large family read its sets
    sets = rows.join(members.hint("merge"), rows.doc_id == members.node).select("node", "component", "chunks", "text").mapInArrow(tidied(_with_sets), "node bigint, component bigint, chunks int, shingles binary")
    sets = written(sets, "sets")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunk") > 0, F.array("chunk")).when(F.col("chunks") > 1, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))
    linked = connected_components(_links(sets.withColumn("chunk", chunk).withColumn("meets", meets), whole=True), n)
    rest = written(unsettled(members.where("chunks > 2"), linked), "unsettled")
    if not rest.isEmpty():
        large = sets.where("chunks > 2").select(F.col("node").alias("x"), "shingles").join(rest.hint("merge"), F.col("x") == F.col("node"))
        linked = connected_components(_links(large, whole=False).unionAll(linked.select("node", "component")), n)
    for done in (sets, rest, members):
        discard(done)
    final = classes.select("k1", "k2", F.col("n_shingles").alias("n"), "node").join(linked, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    out = described.select("doc_id", "n_shingles", F.col("k1").alias("x1"), F.col("k2").alias("x2")).join(final, (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")) & (F.col("n_shingles") == F.col("n")), "left")
    # rows that share an id have the smallest component of any of them only if they are one class; a row without a class is alone
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS node FROM (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id)),
sr AS (SELECT s.doc_id, g FROM s JOIN cls USING (doc_id) WHERE node = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sr a JOIN sr b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node AS a, node AS c FROM (SELECT DISTINCT node FROM cls) UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(cls.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.c, w.doc_id) AS BIGINT) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN cls USING (doc_id) LEFT JOIN m ON m.a = cls.node
"""

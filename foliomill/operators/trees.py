"""Outline trees: parents, depth, level skips and the ordered tree edit distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import importable
from .scan import SPAN, scanned


def depth(toc: DataFrame, *, compat_plus_one: bool = False, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """The largest level; one system's tables keep it plus one."""
    return toc.groupBy(*keys).agg((F.max("level") + int(compat_plus_one)).alias("depth"))


def one_based(toc: DataFrame) -> DataFrame:
    return toc.withColumn("level", F.col("level") + 1)


def skips(toc: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """For each book how often a level is more than one below the one before (0 before the first): such an outline has no balanced tree."""
    rows = scanned(toc.select(*keys, "seq", "level"), keys, ("seq",), lasts={"before": F.col("level")})
    return rows.withColumn("skip", (F.col("level") > F.coalesce("before", F.lit(0)) + 1).cast("int")).groupBy(*keys).agg(F.sum("skip").alias("skips"))


def _nearest(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Adds to rows (keys..., range, seq, level, ...), sorted by these, the seq of the latest earlier row of the same range with a smaller level."""
    last, stack = None, []
    for batch in batches:
        near = []
        key = list(zip(*(batch.column(c).to_pylist() for c in range(keys + 1)), strict=True))
        for k, seq, level in zip(key, batch.column(keys + 1).to_pylist(), batch.column(keys + 2).to_pylist(), strict=True):
            if k != last:
                last, stack = k, []
            while stack and stack[-1][0] >= level:
                stack.pop()
            near.append(stack[-1][1] if stack else None)
            stack.append((level, seq))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], [*batch.schema.names, "near__"])


def carried_parents(ranges: pd.DataFrame) -> pd.DataFrame:
    """Of one book's rows (range__, level, last): for each level of a range the seq that the ranges before it offer as parent.

    What is kept of the ranges before is the stack of open levels; that of two neighbours together is what the later one leaves open of the first, and its own.
    """
    stack: list[tuple[int, int]] = []
    out = []
    for _, part in ranges.sort_values("last").groupby("range__", sort=True):
        for level in part["level"]:
            above = [seq for l, seq in stack if l < level]
            out.append(above[-1] if above else None)
        for level, seq in zip(part["level"], part["last"], strict=True):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, seq))
    found = ranges.sort_values(["range__", "last"], kind="stable")
    return found.assign(carried=pd.array(out, dtype="Int64"))


def parents(toc: DataFrame, keys: tuple[str, ...] = ("book",), span: int | None = None) -> DataFrame:
    """Adds `parent`: the seq of the latest earlier row with a smaller level, null below the root.

    The entries of a book are cut into ranges of seq, and each range is read with a stack of its own. A row whose parent isn't in its range has it from the last row
    of each level in the ranges before: a few summary rows for each range, which are combined book by book. Rows without a level have no parent and are nobody's.
    """
    importable(toc.sparkSession)
    rows = toc.where("level is not null").select(*keys, F.floor(F.col("seq") / F.lit(span or SPAN)).alias("range__"), F.col("seq").cast("bigint").alias("seq__"), "level", *[c for c in toc.columns if c not in (*keys, "level")])
    dealt = rows.repartition(*keys, "range__").sortWithinPartitions(*keys, "range__", "seq__")
    schema = StructType([*rows.schema.fields, StructField("near__", LongType())])
    n = len(keys)
    near = dealt.mapInArrow(lambda x: _nearest(x, n), schema)
    summaries = rows.groupBy(*keys, "range__", "level").agg(F.max("seq__").alias("last"))
    of_book = Window.partitionBy(*keys)
    summaries = summaries.withColumn("m__", F.min("range__").over(of_book) < F.max("range__").over(of_book)).where("m__").drop("m__")  # books of one range need none
    carry = summaries.groupBy(*keys).applyInPandas(carried_parents, StructType([*summaries.schema.fields, StructField("carried", LongType())]))
    carry = carry.select(*[F.col(k).alias(f"k__{k}") for k in (*keys, "range__", "level")], "carried")
    same = F.col("range__") == F.col("k__range__")
    for k in (*keys, "level"):
        same &= F.col(k).eqNullSafe(F.col(f"k__{k}"))
    parent = F.coalesce("near__", "carried").cast(dict(toc.dtypes)["seq"])
    found = near.join(carry, same, "left").select(*toc.columns, parent.alias("parent"))
    return found.unionByName(toc.where("level is null").withColumn("parent", F.lit(None).cast(dict(toc.dtypes)["seq"])))


def outline_tree(items: list[tuple[int, str]]) -> tuple[list[str], list[int]]:
    """Labels and parent indices in preorder, with a root before everything; any smaller level before is the parent."""
    labels, parent, stack = ["root"], [-1], [(0, 0)]
    for level, label in items:
        while stack[-1][0] >= level and len(stack) > 1:
            stack.pop()
        labels.append(label)
        parent.append(stack[-1][1])
        stack.append((level, len(labels) - 1))
    return labels, parent


def has_skip(levels: list[int]) -> bool:
    return any(b > a + 1 for a, b in zip([0, *levels[:-1]], levels, strict=True))


class _Forest:
    """An outline below its root in postorder, for one of the two decompositions: labels, leftmost leaves, key roots and how deep key roots are nested in them.

    With `mirrored` children are taken from right to left. ends: after the last node of each top entry. cost: how many rows of forest distances its key roots need.
    """

    def __init__(self, items: list[tuple[int, str]], mirrored: bool, codes: dict[str, int]):
        labels, parent = outline_tree(items)
        children: list[list[int]] = [[] for _ in labels]
        for k, p in enumerate(parent):
            if p >= 0:
                children[p].append(k)
        if mirrored:
            for c in children:
                c.reverse()
        order, left, nested, ends = [], [], [], []
        at = [0] * len(labels)
        for top in children[0]:
            stack = [(top, 0)]
            while stack:
                node, k = stack.pop()
                if k < len(children[node]):
                    stack.append((node, k + 1))
                    stack.append((children[node][k], 0))
                else:
                    mine = [at[c] for c in children[node]]
                    left.append(left[mine[0]] if mine else len(order))
                    nested.append(max([nested[mine[0]], *[nested[c] + 1 for c in mine[1:]]]) if mine else 0)
                    at[node] = len(order)
                    order.append(labels[node])
            ends.append(len(order))
        self.label = np.array([codes.setdefault(x, len(codes)) for x in order], np.int64)
        self.weight = np.array([int(x != "") for x in order], np.int64)
        self.left, self.nested, self.ends = np.array(left, np.int64), np.array(nested, np.int64), ends
        self._close()

    def _close(self) -> None:
        self.root_of = {l: k for k, l in enumerate(self.left.tolist())}
        self.roots = np.array(sorted(self.root_of.values()), np.int64)
        self.cost = int((self.roots - self.left[self.roots] + 1).sum())

    def tops(self) -> Iterator[tuple[int, int, bytes]]:
        """(first node, after the last, what is equal for equal trees) of each top entry."""
        first = 0
        for end in self.ends:
            yield first, end, self.label[first:end].tobytes() + (self.left[first:end] - first).tobytes()
            first = end

    def distinct(self) -> tuple[_Forest, np.ndarray]:
        """The different trees below the root, each once, and for each node its place there."""
        known: dict[bytes, int] = {}
        taken, ends, place = [], [], np.zeros(len(self.label), np.int64)
        for first, end, key in self.tops():
            if key not in known:
                known[key] = ends[-1] if ends else 0
                taken.append(np.arange(first, end))
                ends.append(known[key] + end - first)
            place[first:end] = np.arange(end - first) + known[key]
        out, of = object.__new__(_Forest), np.concatenate(taken)
        out.label, out.weight, out.nested, out.ends = self.label[of], self.weight[of], self.nested[of], ends
        out.left = np.arange(len(of)) - of + self.left[of]
        out._close()
        return out, place


class _Rows:
    """Tree distances between the nodes of a forest x, in postorder, and all nodes of a forest y, a row at a time.

    The forests of all key roots of y are the columns of one vector, so that each node of x is one vector step for each key root that it is in; nested key roots of y go one level after the
    other where a step needs its own tree distances. The key roots of x that a node is in go on side by side, the innermost first, so a row of tree distances is used up as
    soon as it is there: what is held are a vector for each of them, and those of the rows where an open one of them began. Vectors hold distances less those from the empty forest, and less a
    step from one forest to the next that makes running minima independent.
    """

    def __init__(self, x: _Forest, y: _Forest):
        self.x, self.size = x, len(y.label)
        roots = y.roots[np.argsort(y.nested[y.roots], kind="stable")]
        size = roots - y.left[roots] + 2  # the empty forest, then one more node each
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(roots)), size)
        place = np.arange(int(size.sum())) - start[of]
        node = y.left[roots][of] + place - 1  # the node that a column adds, if place > 0
        inner = place > 0
        gain = np.where(inner, y.weight[node], 0)
        whole = np.cumsum(gain)
        whole = whole - (whole - gain)[start][of]  # the cost of all nodes up to a column
        step = int((x.roots - x.left[x.roots]).max()) + int(size.max()) + 2
        kind = np.int32 if step * (len(roots) + 2) < 1 << 30 else np.int64
        shift = whole + of * step
        base = np.where(inner, start[of] + y.left[node] - y.left[roots][of], 0)
        path = inner & (y.left[node] == y.left[roots][of])
        nest = y.nested[roots][of]
        self.first = (whole - shift).astype(kind)
        self.columns = np.flatnonzero(inner)
        self.node, self.base = node[self.columns], base[self.columns]
        self.move = (shift[self.base] - shift[self.columns]).astype(kind)
        self.levels = []
        for k in range(int(nest[-1]) + 1):
            s = slice(*np.searchsorted(nest, [k, k + 1]).tolist())
            on, off = s.start + np.flatnonzero(path[s]), s.start + np.flatnonzero((inner & ~path)[s])
            self.levels.append((s, on, (shift[on - 1] - shift[on]).astype(kind), y.label[node[on]], node[on], shift[on].astype(kind), off, (whole[base[off]] - shift[off]).astype(kind), node[off]))
        self.kind = kind

    def of(self, first: int, end: int) -> Iterator[np.ndarray]:
        """The rows of the nodes first to end, which are a tree below the root."""
        x, opened = self.x, []  # (key root, its vector, the vectors of rows before open leaves), the outermost first
        for p in range(first, end):
            leaf, cost = int(x.left[p]), int(x.weight[p])
            if leaf == p:
                for o in opened:
                    o[2][p] = o[1]
                opened.append([x.root_of[p], self.first, {}])
            tree = np.empty(self.size, self.kind)
            last = opened[-1]
            row, best = last[1], last[1] + self.kind(cost)
            for s, on, on_move, label, on_node, on_shift, off, off_base, off_node in self.levels:
                best[on] = np.minimum(best[on], row[on - 1] + on_move + (label != x.label[p]))
                if len(off):
                    best[off] = np.minimum(best[off], off_base + tree[off_node])
                np.minimum.accumulate(best[s], out=best[s])
                tree[on_node] = best[on] + on_shift
            last[1] = best
            if len(opened) > 1:
                near = tree[self.node] + self.move
                for o in opened[-2::-1]:
                    best = o[1] + self.kind(cost)
                    best[self.columns] = np.minimum(best[self.columns], o[2][leaf][self.base] + near)
                    o[1] = np.minimum.accumulate(best)
            if last[0] == p:
                opened.pop()
                for o in opened:
                    del o[2][leaf]
            yield tree


#: Bytes of tree distances that are kept of trees that stand in an outline more than once.
KEPT_BYTES = 64 << 20


def sequence_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of labels. All differences of a row of distances are the bits of two integers, so that a row is a dozen operations on integers of len(b) bits."""
    at: dict[str, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full, top, score = (1 << len(b)) - 1, 1 << max(len(b) - 1, 0), len(b)
    up, down = full, 0
    for x in a:
        same = at.get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(zero | up)), up & zero
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(zero | more)) & full, more & zero & full
    return score if b else len(a)


def tree_edit_distance(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> float:
    """Ordered tree edit distance of two outlines (level, label). Renaming costs 1 if the labels differ; inserting or deleting a node costs 1, and nothing
    if its label is empty.

    The roots are equal, and some best mapping maps one to the other, so what is compared are the forests below them: one table of forest distances, whose rows are vectors, from the tree distances of
    the trees below the root, by key roots of the left or of the right (mirrored) decomposition, whichever has fewer subproblems. Equal trees of one outline are compared once, as far as
    KEPT_BYTES go. A row is kept only while a later one starts from it, so memory grows with the outlines and their depth, not with the product of their sizes. Outlines
    of one level are sequences.
    """
    if len({level for level, _ in (*a, *b)}) <= 1:
        return float(sequence_distance([x for _, x in a if x != ""], [x for _, x in b if x != ""]))  # an empty label costs nothing to leave out
    codes: dict[str, int] = {}
    x, y = min(((_Forest(a, m, codes), _Forest(b, m, codes)) for m in (False, True)), key=lambda t: t[0].cost * t[1].cost)
    if len(x.label) > len(y.label):  # the costs are symmetric; vectors are longer than the rows are many
        x, y = y, x
    if not len(x.label):
        return float(y.weight.sum())
    unlike, place = y.distinct()
    rows = _Rows(x, unlike)
    often = Counter(key for _, _, key in x.tops())
    room, held = KEPT_BYTES, {}
    for key, n in often.most_common():
        nbytes = len(key) // 16 * (np.dtype(rows.kind).itemsize * len(unlike.label) + 100)
        if n > 1 and nbytes <= room:
            held[key] = None
            room -= nbytes
    whole = np.concatenate([[0], np.cumsum(y.weight)])
    move = (whole[y.left] - whole[1:]).astype(np.int32)
    row = np.zeros(len(whole), np.int32)  # less `whole`
    for first, end, key in x.tops():
        trees = held.get(key)
        if trees is None:
            trees = rows.of(first, end)
            if key in held:
                trees = held[key] = list(trees)
        before: dict[int, np.ndarray] = {}  # of the row before each open leaf: what it has where each node's tree begins
        for p, tree in zip(range(first, end), trees, strict=True):
            leaf = int(x.left[p])
            if leaf == p:
                before[p] = row[y.left] + move
            row = row + np.int32(x.weight[p])
            np.minimum(row[1:], before[leaf] + tree.astype(np.int32, copy=False)[place], out=row[1:])
            np.minimum.accumulate(row, out=row)
            if x.root_of[leaf] == p:
                del before[leaf]
    return float(row[-1] + whole[-1])


def edit_distances(system: DataFrame, truth: DataFrame, *, mode: str = "compat", keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(book, etd) for the books of both; null in compat where an outline skips a level. Pairs are dealt out again by their keys, many parts for each core, before they are compared."""
    importable(system.sparkSession)

    def packed(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "level", "heading"))).alias("rows"))
        return rows.select(*keys, F.transform("rows", lambda x: x["level"]).alias(f"{name}_levels"), F.transform("rows", lambda x: x["heading"]).alias(f"{name}_headings"))

    @F.pandas_udf("double")
    def distance(a_levels: pd.Series, a_headings: pd.Series, b_levels: pd.Series, b_headings: pd.Series) -> pd.Series:
        out = []
        for al, ah, bl, bh in zip(a_levels, a_headings, b_levels, b_headings, strict=True):
            if {al.dtype.kind, bl.dtype.kind} != {"i"}:
                raise ValueError("an entry has no level")
            x, y = list(zip(al.tolist(), ah.tolist(), strict=True)), list(zip(bl.tolist(), bh.tolist(), strict=True))
            bad = mode == "compat" and (has_skip([r[0] for r in x]) or has_skip([r[0] for r in y]))
            out.append(None if bad else tree_edit_distance(x, y))
        return pd.Series(out, dtype="float64")

    both = packed(system, "a").join(packed(truth, "b"), list(keys)).repartition(8 * system.sparkSession.sparkContext.defaultParallelism, *keys)
    return both.select(*keys, distance("a_levels", "a_headings", "b_levels", "b_headings").alias("etd"))


def books_by_depth(toc: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(depth, n, least, most): how many books are of each depth, and the first and last of their names."""
    return depth(toc, keys=keys).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min(keys[0]).alias("least"), F.max(keys[0]).alias("most"))


def headings_by_level(toc: DataFrame) -> DataFrame:
    """(book, level, n, first): the number of headings of each level and the first of them."""
    return toc.groupBy("book", "level").agg(F.count(F.lit(1)).alias("n"), F.min_by("heading", "seq").alias("first"))

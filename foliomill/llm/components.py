"""Connected components of an edge table by alternating large-star and small-star steps, with nothing collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded_batches, discard, written

#: Into so many parts the edges of each node are cut where they are joined.
SALTS = 32
#: Edges in one file of a step, about.
FILE_ROWS = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that aren't the smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, a few hundred thousand at once, replaced by stars of the same components."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        e = np.concatenate(held, 1)
        a, b = forest(e[0], e[1])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        e = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held.append(e)
        size += e.shape[1]
        if size > 300_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, about: int) -> DataFrame:
    """(node, component) for every node of edges (a, b) of bigint ids but the smallest of each component. about: how many edges there are, roughly.

    Steps go on until one changes nothing, which is after about log2 of the longest path. Minima are aggregated before they are shuffled. Each step is written to the shared folder, in files of about FILE_ROWS rows, so lineage
    stays short and a lost executor costs no more than its tasks.
    """
    bounded_batches(edges.sparkSession)
    flat = edges.where("a <> b").mapInArrow(_local, "a bigint, b bigint")
    now, seen = written(flat, "edges"), None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # A node with very many larger neighbours is mostly the smallest of them all, and its edges stay; those of any node are salted.
        moved = least.where("m < n").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        large = both.where("b > a").withColumn("t", F.pmod(F.hash("b"), F.lit(SALTS))).join(moved, (F.col("a") == F.col("n")) & (F.col("t") == F.col("s")), "left")
        large = large.select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).where("a <> b").distinct()
        # From here on a is the larger end, which has few edges: one for each smallest neighbour that its own neighbours have.
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", low)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, now = now, written(small.coalesce(about // FILE_ROWS + 1), "edges")
        discard(before)
        # done when a step changes nothing
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, about = mark, 2 * mark[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

"""Heading candidates from typography, and their refinement in token-bounded batches."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import importable, written

#: Elements of a font up to which its text is a candidate; share of the largest count that makes a size a baseline.
RARE, BASELINE = 220, 0.5


def histogram(rows: DataFrame, by: str, order: str = "seq", book: str = "book") -> DataFrame:
    """(book, by, n, rank): most common first, ties by first appearance."""
    counts = rows.groupBy(book, by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("n"), "first_seen"))).drop("first_seen")


def baseline(counts: DataFrame, share: float = BASELINE, book: str = "book") -> DataFrame:
    """The values whose count is above `share` of the largest."""
    return counts.withColumn("most", F.max("n").over(Window.partitionBy(book))).where(F.col("n") > F.col("most") * F.lit(share)).drop("most")


def rare(rows: DataFrame, by: str = "font_id", most: int = RARE, book: str = "book") -> DataFrame:
    """Rows whose value of `by` occurs at most `most` times in the book. The counts are aggregated before they are joined back."""
    few = rows.groupBy(book, by).count().where(F.col("count") <= most).drop("count")
    return rows.join(few, [book, by], "left_semi")


def by_style(rows: DataFrame, most: int = 300) -> DataFrame:
    """The style rule: larger than every baseline size, or bold, or italic, in a font of at most `most` elements; level by falling size."""
    sizes = baseline(histogram(rows, "font_size")).groupBy("book").agg(F.max("font_size").alias("body"))
    found = rare(rows, "font_id", most).join(sizes, "book", "left").where((F.col("font_size") > F.col("body")) | F.col("bold") | F.col("italic"))
    return found.withColumn("level", F.dense_rank().over(Window.partitionBy("book").orderBy(F.desc("font_size"))))


def without_candidates(books: DataFrame, candidates: DataFrame) -> DataFrame:
    return books.join(candidates.select("book").distinct(), "book", "left_anti").select("book", F.lit("NO_CANDIDATES").alias("reason"))


def greedy_batches(tokens: np.ndarray, limit: int) -> np.ndarray:
    """The batch of each item: a batch is closed before the item that would take it beyond the limit, even an empty one. One step a batch, by search in prefix sums."""
    ends = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    closed = np.zeros(len(tokens), np.int32)
    at = 0
    first = int(np.searchsorted(ends, limit, "right")) - 1
    while (start := at + first) < len(tokens):  # item `start` would go beyond the limit
        closed[start] = 1
        at = start
        first = max(1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1 - at)
    return np.cumsum(closed, dtype=np.int32)


def batch_numbers(tokens: Column, limit: int) -> Column:
    """For an ordered array of token counts, the batch of each. An item that alone is beyond the limit closes the batch before it, even an empty one."""
    return F.pandas_udf(lambda t: t.map(lambda x: None if x is None else greedy_batches(x, limit)), "array<int>")(tokens)


def last_per_level(rows: DataFrame, level: str = "level", order: str = "seq", book: str = "book") -> DataFrame:
    """The latest row of each level, the most recent first; a missing level counts as 1."""
    filled = rows.withColumn(level, F.coalesce(F.col(level), F.lit(1).cast(rows.schema[level].dataType)))
    best = filled.withColumn("r_", F.row_number().over(Window.partitionBy(book, level).orderBy(F.desc(order)))).where("r_ = 1").drop("r_")
    return best.withColumn("recency", F.row_number().over(Window.partitionBy(book).orderBy(F.desc(order))))


def parsed_response(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of quoted three-field lines: the level stays a string, a page that is no number is null."""
    lines = rows.select("*", F.posexplode(F.split(raw, "\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    csv = F.from_csv("line", F.lit("a string, b string, c string, d string"), {"escape": '"'})
    cut = lines.withColumn("f", csv).withColumn("ok", F.col("f.c").isNotNull() & F.col("f.d").isNull() & ~F.rtrim("line").endswith(",,"))
    good = cut.where("ok").select(*rows.columns, "line_no", F.col("f.a").alias("level"), F.col("f.b").alias("heading"), T.safe_int("f.c").alias("page"))
    return good, cut.where("not ok").select(*rows.columns, "line_no", "line")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("level is not null and heading is not null and page is not null")


def unique_candidates(rows: DataFrame) -> DataFrame:
    """One row for each heading and page of a book, the first."""
    return rows.groupBy("book", "heading", "page").agg(F.min("seq").alias("seq"))


#: (titles of a batch, latest title of each level) -> refined rows {level, heading, page}
Refiner = Callable[[list[dict], list[dict]], list[dict]]


def style_refiner(batch: list[dict], context: list[dict]) -> list[dict]:
    """The default: candidates as they are, with the level that the style rule gave them."""
    return [{"level": r.get("level") or 1, "heading": r["heading"], "page": r["page"]} for r in batch if r["heading"]]


@contextmanager
def _deadline(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError inside once so many seconds have gone, whatever runs there."""
    if seconds is None:
        yield
        return

    def late(*_) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def refine(candidates: DataFrame, refiner: Refiner = style_refiner, *, limit: int = 8192 - 1800 - 1000, fixed: int = 0) -> DataFrame:
    """Refined outlines (book, seq, level, heading, page). Within a book batches go one after another, since the context of each is what came out
    of those before; books go in parallel. candidates: book, seq, level, heading, page, tokens."""
    return _refined(candidates, refiner, limit, fixed, None).drop("reason")


def refine_within(candidates: DataFrame, seconds: float, refiner: Refiner = style_refiner, *, limit: int = 8192 - 1800 - 1000, fixed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): as refine(), with a limit of time for each book. A book that takes longer has no rows and is a reject (book, reason); the others go on."""
    found = written(_refined(candidates, refiner, limit, fixed, seconds), "refined")
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("book", "reason")


def _refined(candidates: DataFrame, refiner: Refiner, limit: int, fixed: int, seconds: float | None) -> DataFrame:
    importable(candidates.sparkSession)
    names = ["book", "seq", "level", "heading", "page", "reason"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        batch: list[dict] = []
        used = 0

        def context() -> list[dict]:
            latest: dict = {}
            for r in reversed(out):
                latest.setdefault(r["level"] or 1, r)
            return list(latest.values())

        def flush() -> None:
            found = refiner(batch, context())
            out.extend(r for r in found if {"level", "heading", "page"} <= r.keys())

        book = frame["book"].iloc[0]
        try:
            with _deadline(seconds):
                for row in frame.sort_values("seq").to_dict("records"):
                    around = fixed + sum(len(str(c["heading"]).split()) for c in context())
                    if around + used + row["tokens"] > limit:
                        flush()
                        batch, used = [], 0
                    batch.append(row)
                    used += row["tokens"]
                if batch:
                    flush()
        except TimeoutError:
            return pd.DataFrame([(book, None, None, None, None, "TIME_LIMIT")], columns=names)
        return pd.DataFrame([(book, k, r["level"], r["heading"], r["page"], None) for k, r in enumerate(out)], columns=names)

    return candidates.groupBy("book").applyInPandas(one, "book string, seq int, level int, heading string, page int, reason string")


def replayed(batches: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of stored responses (book, batch, raw) to the batches (book, batch) that were asked: an equality join instead of a remote call.

    A batch without a response, or with a line that doesn't parse, has a reject (book, batch, line_no, line, reason). Of several responses to a batch the smallest text counts.
    """
    one = responses.groupBy("book", "batch").agg(F.min("raw").alias("raw"))
    asked = batches.select("book", "batch").distinct().join(one, ["book", "batch"], "left")
    good, bad = parsed_response(asked.where("raw is not null"))
    none = asked.where("raw is null").select("book", "batch", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("NO_RESPONSE").alias("reason"))
    rejects = bad.select("book", "batch", "line_no", "line", F.lit("NOT_A_ROW").alias("reason")).unionByName(none)
    return valid(good).select("book", "batch", "line_no", "level", "heading", "page"), rejects

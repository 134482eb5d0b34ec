"""Scores of a system against the truth: heading precision and recall, segment boundaries, Pk and WindowDiff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import scanned


#: Characters up to which a heading has a key for each of them; longer ones have keys of their halves.
SHORT = 64


def near_keys(heading: F.Column) -> F.Column:
    """64-bit keys of which two headings at edit distance 0 or 1 share one.

    Up to SHORT + 1 characters: the hash of the heading, and of each form with one character left out. From SHORT characters on: the one edit is in one
    half, so the other half stands unchanged at its end, whatever the length of the heading that was edited: the halves for the own length, and the
    beginnings and ends as long as the halves of headings that are one character shorter or longer. So keys are few and of fixed size for any heading.
    """
    n = F.length(heading)
    none = F.array().cast("array<bigint>")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.concat(F.substr(heading, F.lit(1), i - 1), F.substr(heading, i + 1))))
    short = F.when(n <= SHORT + 1, F.concat(F.array(F.xxhash64(heading)), F.when(n > 0, cut).otherwise(none))).otherwise(none)

    def halves(length: F.Column) -> list[F.Column]:
        first = F.floor(length / 2).cast("int")
        return [F.xxhash64(F.lit("p"), length, F.substr(heading, F.lit(1), first)), F.xxhash64(F.lit("s"), length, F.substr(heading, n - (length - first) + 1))]

    long = F.when(n >= SHORT, F.array(*halves(n - 1), *halves(n), *halves(n + 1))).otherwise(none)
    return F.array_distinct(F.concat(short, long))


def _matched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct (key, heading) of a with whether b has the heading exactly, and whether it has one at distance 0 or 1."""
    x, y = a.select(key, "heading").distinct(), b.select(key, "heading").distinct()
    exact = x.join(y.withColumn("exact", F.lit(True)), [key, "heading"], "left")
    other = y.select(F.col(key).alias("k2"), F.col("heading").alias("h2"), F.explode(near_keys(F.col("heading"))).alias("n2"))
    near = x.select(key, "heading", F.explode(near_keys(F.col("heading"))).alias("near"))
    near = near.join(other, (F.col(key) == F.col("k2")) & (F.col("near") == F.col("n2"))).where(T.within_one(F.col("heading"), F.col("h2"))).select(key, "heading").distinct().withColumn("tolerant", F.lit(True))
    return exact.join(near, [key, "heading"], "left").select(key, "heading", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("tolerant", F.lit(False)).alias("tolerant"))


def precision_recall(system: DataFrame, truth: DataFrame, key: str = "book") -> DataFrame:
    """(key, n_truth, n_system, precision, tolerant_precision, recall, tolerant_recall) for every key of the truth.

    Occurrences of a side are looked up in the set of the other; a key without system rows scores 0. Tolerance is an equality join on
    forms with one character left out, confirmed by the distance, not a comparison of all pairs.
    """

    def share(a: DataFrame, b: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        hit = _matched(a, b, key)
        return a.select(key, "heading").join(hit, [key, "heading"]).groupBy(key).agg(F.count(F.lit(1)).alias(names[0]), F.avg(F.col("exact").cast("double")).alias(names[1]), F.avg(F.col("tolerant").cast("double")).alias(names[2]))

    a, b = share(system, truth, ("n_system", "precision", "tolerant_precision")), share(truth, system, ("n_truth", "recall", "tolerant_recall"))
    out = b.join(a, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(key, "n_truth", F.coalesce("n_system", F.lit(0)).alias("n_system"), zero("precision"), zero("tolerant_precision"), zero("recall"), zero("tolerant_recall"))


def boundaries(units: DataFrame, *, book: str = "book", order: tuple[str, ...] = ("sec_seq", "pos"), text: str = "text") -> DataFrame:
    """(book, total, positions): a unit of text is its characters but spaces, then a boundary; a null unit is a boundary alone; the last boundary is dropped.

    positions are those of the boundaries among `total` places. The ends are a scan over ranges of order[0]; only sizes go through it, no text.
    """
    size = F.coalesce(F.length(T.squeezed(text)), F.lit(0)) + 1
    rows = scanned(units.select(book, *order, size.alias("size")), (book,), order, sums={"end": F.col("size")}, inclusive=True)
    ends = rows.groupBy(book).agg((F.max("end") - 1).alias("total"), F.array_sort(F.collect_list(F.col("end") - 1)).alias("ends"))
    return ends.select(book, "total", F.slice("ends", 1, F.size("ends") - 1).alias("positions"))


def window_size(total: F.Column, a: F.Column, b: F.Column, default: int = 5) -> F.Column:
    """Half of the mean segment length of both, rounded down; the default if a side has no boundary."""
    return F.when((a > 0) & (b > 0), F.floor((total / a + total / b) / 2)).otherwise(default).cast("int")


def window_scores(total: F.Column, a: F.Column, b: F.Column, k: F.Column) -> tuple[F.Column, F.Column]:
    """Pk and WindowDiff over all windows of k places, from sorted arrays of boundaries; null if a window doesn't fit.

    A sweep over the windows' starts: a boundary at p enters with the window that starts at p - k + 1 and leaves with the one after p. Between these events the counts of
    both sides stand still, so the work grows with the boundaries alone, not with the places.
    """
    n = (total - k + 1).cast("bigint")

    def events(positions: F.Column, x: int, y: int) -> F.Column:
        enters = F.transform(positions, lambda p: F.struct(F.greatest(p - k + 1, F.lit(0)).cast("bigint").alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")))
        leaves = F.transform(positions, lambda p: F.struct(F.least(p + 1, n).cast("bigint").alias("at"), F.lit(-x).alias("x"), F.lit(-y).alias("y")))
        return F.concat(enters, leaves)

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.lit(0).alias("x"), F.lit(0).alias("y"), zero.alias("pk"), zero.alias("wd"))

    def step(acc: F.Column, e: F.Column) -> F.Column:
        width = e["at"] - acc["at"]
        return F.struct(
            e["at"].alias("at"), (acc["x"] + e["x"]).alias("x"), (acc["y"] + e["y"]).alias("y"), (acc["pk"] + F.when((acc["x"] > 0) != (acc["y"] > 0), width).otherwise(zero)).alias("pk"),
            (acc["wd"] + F.when(acc["x"] != acc["y"], width).otherwise(zero)).alias("wd"),
        )

    swept = F.aggregate(F.array_sort(F.concat(events(a, 1, 0), events(b, 0, 1))), start, step)
    fits = (k >= 1) & (n >= 1)
    return F.when(fits, F.try_divide(swept["pk"], n)), F.when(fits, F.try_divide(swept["wd"], n))


def segmentation_scores(truth: DataFrame, system: DataFrame, book: str = "book", exclude: list[str] | None = None) -> DataFrame:
    """(book, total, k, pk, windowdiff) for the books of both boundary tables but those in `exclude`; the shorter one is padded."""
    if exclude:
        truth = truth.where(~F.col(book).isin(exclude))
    both = truth.select(book, F.col("total").alias("t1"), F.col("positions").alias("a")).join(system.select(book, F.col("total").alias("t2"), F.col("positions").alias("b")), book)
    both = both.withColumn("total", F.greatest("t1", "t2")).withColumn("k", window_size(F.col("total"), F.size("a"), F.size("b")))
    pk, wd = window_scores(F.col("total"), F.col("a"), F.col("b"), F.col("k"))
    return both.select(book, "total", "k", pk.alias("pk"), wd.alias("windowdiff"))


def section_units(sections: DataFrame) -> DataFrame:
    """The content items of sections as units; the empty first segment has none, and headings aren't part of them."""
    return sections.where("content is not null").select("book", "sec_seq", F.posexplode("content").alias("pos", "text"))


def layout_units(items: DataFrame) -> DataFrame:
    """Heading and content of a layout parser's items as one unit each."""
    return items.select("book", F.posexplode("items").alias("sec_seq", "i")).select("book", "sec_seq", F.lit(0).alias("pos"), F.concat(F.coalesce("i.heading", F.lit("")), F.coalesce("i.content", F.lit(""))).alias("text"))

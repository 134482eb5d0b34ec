"""Distributions of scores by outline depth, axis limits and dimension look-ups, as tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, written
from .scan import scanned

#: Ranges of a value that its ranks are scanned in.
RANGES = 256


def quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, at: tuple[float, ...]) -> DataFrame:
    """(keys..., n, mean, q0, q1, ...): exact quantiles of the values that aren't null, interpolated linearly between neighbours.

    The distinct values of a group are counted, a scan over ranges of the value gives the rank of each, and the values at the wanted ranks are picked. No task
    holds the values of a group: the ranges come from one quantile sketch of all values, at most RANGES of them.
    """
    counts = written(rows.groupBy(*keys, F.col(value).alias("value__")).agg(F.count(F.lit(1)).alias("n__")), "counts")
    some = counts.where(F.col("value__").isNotNull())
    marks = some.agg(F.percentile_approx("value__", [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(m) for m in sorted(set(marks))]), lambda m: m < F.col("value__"))) if marks else F.lit(0)
    ranked = scanned(some.withColumn("place__", place), keys, ("place__", "value__"), sums={"before": F.col("n__")}, span=1)
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("value__").isNotNull(), F.col("n__"))), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("value__") * F.col("n__")), F.sum(F.when(F.col("value__").isNotNull(), F.col("n__")))).alias("mean"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k__{k}"))
    sized = ranked.join(totals.select(*[F.col(k).alias(f"k__{k}") for k in keys], F.col("n").alias("all__")), same)
    ranks = [F.lit(q) * (F.col("all__") - 1) for q in at]
    here = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n__")), F.col("value__")))
    picked = sized.groupBy(*keys).agg(*[here(F.floor(r)).alias(f"low{k}") for k, r in enumerate(ranks)], *[here(F.ceil(r)).alias(f"high{k}") for k, r in enumerate(ranks)])
    picked = picked.select(*[F.col(k).alias(f"k__{k}") for k in keys], *[c for k in range(len(at)) for c in (f"low{k}", f"high{k}")])
    share = [F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for q in at]
    done = [(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * x).alias(f"q{k}") for k, x in enumerate(share)]
    out = written(totals.join(picked, same, "left").select(*keys, "n", "mean", *done), "quantiles")  # a row for each group
    discard(counts)
    return out


def by_depth(scores: DataFrame, *, keys: tuple[str, ...] = ("system", "metric"), depth: str = "gt_depth", value: str = "value", missing: float | None = None) -> DataFrame:
    """The five-number summary of each depth, and of all depths together (depth null). missing: what a null score counts as; null leaves it out."""
    rows = scores if missing is None else scores.fillna({value: missing})
    both = F.array(F.struct(F.lit(False).alias("all"), F.col(depth).alias("depth")), F.struct(F.lit(True).alias("all"), F.lit(None).cast(dict(rows.dtypes)[depth]).alias("depth")))
    each = rows.select(*keys, F.col(value).cast("double").alias(value), F.explode(both).alias("d")).select(*keys, value, "d.*")
    found = quantiles(each, (*keys, "all", "depth"), value, (0.0, 0.25, 0.5, 0.75, 1.0))
    names = ("least", "q1", "median", "q3", "most")
    return found.select(*keys, F.col("depth").alias(depth), "n", "mean", *[F.col(f"q{k}").alias(x) for k, x in enumerate(names)])


def axis_limits(scores: DataFrame, value: str = "value", keys: tuple[str, ...] = (), share: float = 0.05) -> DataFrame:
    low, high = F.min(value), F.max(value)
    return scores.groupBy(*keys).agg((low - (high - low) * F.lit(share)).alias("low"), (high + (high - low) * F.lit(share)).alias("high"))


def with_group(scores: DataFrame, groups: DataFrame, *, key: str = "book", group: str = "publisher_group", markers: int = 8) -> DataFrame:
    """Adds each book's group and the index of its marker. A book without a group keeps its row."""
    rows = scores.join(groups.select(key, group), key, "left")
    return _ranked(rows, group, markers)


def _ranked(rows: DataFrame, group: str, markers: int) -> DataFrame:
    """Ranks the distinct groups, not the rows, so that only a short list meets in one task."""
    ranks = rows.select(group).distinct().withColumn("marker", (F.dense_rank().over(Window.orderBy(group)) - 1) % markers).withColumnRenamed(group, "g_")
    return rows.join(ranks, F.col(group).eqNullSafe(F.col("g_")), "left").drop("g_")


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    return rows.groupBy(label).agg(F.min(order).alias(order))


def pivoted(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each book and system with a column for each metric."""
    return scores.groupBy("book", "system").pivot("metric", metrics).agg(F.first("value"))


def extremes(scores: DataFrame, keys: tuple[str, ...] = ("system", "metric")) -> DataFrame:
    """The lowest and highest score of each system and metric, with a book that has it."""
    return scores.groupBy(*keys).agg(F.min(F.struct("value", "book")).alias("low"), F.max(F.struct("value", "book")).alias("high")).select(*keys, F.col("low.value").alias("low"), F.col("low.book").alias("low_book"), F.col("high.value").alias("high"), F.col("high.book").alias("high_book"))


def rebucketed(scores: DataFrame, depths: DataFrame, **options) -> DataFrame:
    """by_depth() with the depth of each book taken from another table (book, depth); a book without one is left out."""
    return by_depth(scores.drop("gt_depth").join(depths.withColumnRenamed("depth", "gt_depth"), "book"), **options)

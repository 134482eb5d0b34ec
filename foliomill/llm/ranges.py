"""Ranges of an id that hold about the same number of bytes of text, numbered in the order of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

#: Splits that are taken from a quantile sketch at once; more ranges than that come from a second sketch in each of them.
SPLITS = 1024
#: Bytes of text that weigh as one row in the sketches.
GRAIN = 4096
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _quantiles(weighted: DataFrame, name: str, parts: int, *by: str) -> DataFrame:
    marks = F.percentile_approx(name, [k / parts for k in range(1, parts)], 20 * SPLITS)
    return weighted.groupBy(*by).agg(F.array_distinct(marks).alias("marks__"))


def with_ranges(df: DataFrame, id_col: str, text_col: str, most_bytes: int, name: str) -> tuple[DataFrame, int]:
    """df with the range of each row of a bigint id, and the number of ranges, of about `most_bytes` of text each.

    Rows with equal ids share a range; null ids are in the first. What comes to the driver is at most SPLITS numbers; at most SPLITS arrays of
    as many are broadcast, so ranges grow beyond SPLITS ** 2 of them.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-size // most_bytes))
    if n == 1:
        return df.withColumn(name, F.lit(0)), 1
    weighted = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i__"), F.explode(F.sequence(F.lit(0), F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / GRAIN).cast("int"))))
    below = lambda marks, x: F.greatest(F.coalesce(F.size(F.filter(marks, lambda m: m < x)), F.lit(0)), F.lit(0))
    coarse = min(n, SPLITS)
    marks = _quantiles(weighted, "i__", coarse).first()[0] or []
    at = below(F.array(*[F.lit(m).cast("bigint") for m in sorted(marks)]), F.col(id_col)) if marks else F.lit(0)
    at = F.when(F.col(id_col).isNull(), 0).otherwise(at)
    fine = min(-(-n // coarse), SPLITS)
    if fine == 1:
        return df.withColumn(name, at.cast("int")), coarse
    inner = weighted.withColumn("c__", F.when(F.col("i__").isNull(), 0).otherwise(below(F.array(*[F.lit(m).cast("bigint") for m in sorted(marks)]), F.col("i__"))))
    inner = _quantiles(inner, "i__", fine, "c__")
    out = df.withColumn("c__at", at).join(F.broadcast(inner), F.col("c__at") == F.col("c__"), "left")
    where = F.col("c__at") * fine + F.when(F.col(id_col).isNull(), 0).otherwise(below(F.col("marks__"), F.col(id_col)))
    return out.withColumn(name, where.cast("int")).drop("c__at", "c__", "marks__"), coarse * fine


def numbered(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """df with a bigint column whose order is that of the id: the id itself if it is an integer, otherwise a number for each distinct id. Null stays null."""
    if dict(df.dtypes)[id_col] in INTEGERS:
        return df.withColumn(name, F.col(id_col).cast("bigint"))
    ids = df.select(F.col(id_col).alias("id__")).where("id__ is not null").distinct()
    ids = written(ids.repartitionByRange("id__").sortWithinPartitions("id__").select("id__", F.monotonically_increasing_id().alias(name)), "numbers")
    return df.join(ids, F.col(id_col) == F.col("id__"), "left").drop("id__")

"""Resolving destination references to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, written


def page_numbers(pages: DataFrame, order: str = "seq") -> DataFrame:
    """Adds page: the number of a page in its book, from 1."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("book").orderBy(order)))


def resolve(refs: DataFrame) -> DataFrame:
    """(book, ref, page) for each reference (book, ref, kind, next_ref, page): the page it has, or that of what it names, and so on.

    An unknown kind, a missing target and a chain that doesn't end have no page. Pointers are doubled, so k joins follow 2 ** k links, and no
    more joins are made than the longest chain needs: a chain longer than there are references is a ring and has no end. Each step
    is written to the shared folder, as it is read twice by the next.
    """
    known = F.col("kind").isin("objref", "dict", "list", "named")
    now = refs.select("book", "ref", F.when(known, F.col("page")).alias("page"), F.when(known & F.col("page").isNull(), F.col("next_ref")).alias("next"))
    followed, rows, held = 1, None, None
    while True:
        now = written(now, "references")
        if held is not None:
            discard(held)
        held, rows = now, now.count() if rows is None else rows
        if followed > rows or now.where("next is not null").isEmpty():
            break
        followed *= 2
        target = now.select(F.col("book").alias("b_"), F.col("ref").alias("r_"), F.col("page").alias("p_"), F.col("next").alias("n_"))
        now = now.join(target, (F.col("book") == F.col("b_")) & (F.col("next") == F.col("r_")), "left").select("book", "ref", F.coalesce("page", "p_").alias("page"), F.when(F.col("page").isNull() & F.col("p_").isNull(), F.col("n_")).alias("next"))
    return now.select("book", "ref", "page")


def entry_page(toc: DataFrame, refs: DataFrame, columns: tuple[str, ...] = ("dest", "action", "element")) -> DataFrame:
    """Adds page to outline entries: that of the first of the three references that is there."""
    resolved = resolve(refs).withColumnRenamed("book", "b_")
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    return toc.withColumn("ref_", first).join(resolved, (F.col("book") == F.col("b_")) & (F.col("ref_") == F.col("ref")), "left").drop("b_", "ref", "ref_")

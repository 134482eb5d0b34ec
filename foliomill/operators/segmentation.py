"""Cutting page text into the sections of an outline, as joins and windows.

`compat` keeps the semantics of the sequential procedure this replaces: a page is scanned once for each of its headings, so text before a hit
goes to the section that is open then (again for the next heading), pages without headings and text after a page's last
hit are dropped, an entry whose page goes back or doesn't exist makes every later entry unreachable, and the first segment is empty.
`full` assigns every element once, to the last heading before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import written
from .matching import first_hits
from .scan import numbered, scanned


def rejected_books(toc: DataFrame) -> DataFrame:
    """Books with an entry without a page: they fail as a whole."""
    return toc.where(F.col("page").isNull()).select("book").distinct().withColumn("reason", F.lit("NULL_PAGE"))


def reachable(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries that a single forward pass over the pages comes to: those of a book before its first bad one."""
    known = pages.select("book", "page").distinct().withColumn("there", F.lit(True))
    before = scanned(toc, ("book",), ("seq",), lasts={"before": F.col("page")})
    bad = F.coalesce(F.col("page") < F.col("before"), F.lit(False)) | F.col("there").isNull()
    stall = before.join(known, ["book", "page"], "left").where(bad).groupBy("book").agg(F.min("seq").alias("stall"))
    return toc.join(stall, "book", "left").where("stall is null or seq < stall").drop("stall")


def lines(elements: DataFrame) -> DataFrame:
    """(book, page, line, top, text): elements that share `top`, in order of first appearance, by their inline text."""
    part = F.array_sort(F.collect_list(F.struct("seq", "text_inline")))
    rows = elements.groupBy("book", "page", "top").agg(F.min("seq").alias("line"), part.alias("parts"))
    joined = F.array_join(F.filter(F.transform("parts", lambda x: x["text_inline"]), lambda x: x != ""), " ")
    return rows.select("book", "page", "line", "top", T.trimmed(joined).alias("text"))


def hits(toc: DataFrame, elements: DataFrame, *, both_ways: bool = True) -> DataFrame:
    """Entries with `hit` (an element) or, where no element matches, `line_hit` (a line), and `opens` if either is there."""
    found = toc.join(first_hits(toc, elements.withColumnRenamed("seq", "el"), ["text_head", "text_inline"], "el", both_ways=both_ways), ["book", "seq"], "left")
    found = written(found, "hits")  # narrow rows, read by both of what follows
    missed = found.where("hit is null").drop("hit")
    if missed.isEmpty():
        return found.withColumn("line_hit", F.lit(None).cast("int")).withColumn("opens", F.lit(True))
    elements = elements.join(missed.select("book", "page").distinct(), ["book", "page"], "left_semi")
    by_line = first_hits(missed, lines(elements), ["text"], "line", both_ways=both_ways).withColumnRenamed("hit", "line_hit")
    return found.join(by_line, ["book", "seq"], "left").withColumn("opens", F.col("hit").isNotNull() | F.col("line_hit").isNotNull())


def owners(matched: DataFrame) -> DataFrame:
    """Adds `owner`: the last entry before this one that opened a section."""
    return scanned(matched, ("book",), ("seq",), lasts={"owner": F.when(F.col("opens"), F.col("seq"))})


def _collected(headings: DataFrame, content: DataFrame) -> DataFrame:
    """Sections (book, sec_seq, level, heading, content) from headings (book, seq) and content (book, owner, at..., text)."""
    texts = content.groupBy("book", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "text"))), lambda x: x["text"]).alias("content"))
    headings = numbered(headings.select("book", "seq", "level", "heading"), ("book",), ("seq",), "sec_seq", 1)
    rows = headings.join(texts, (headings.book == texts.book) & (headings.seq == texts.owner), "left").select(headings.book, F.col("sec_seq").cast("int").alias("sec_seq"), "level", "heading", F.coalesce("content", F.array().cast("array<string>")).alias("content"))
    return rows.select("book", "sec_seq", "level", "heading", "content")


def segment(toc: DataFrame, elements: DataFrame, pages: DataFrame | None = None, *, mode: str = "compat", strict_unopened: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """Sections (book, sec_seq, level, heading, content) of the books with at least one matched heading; in compat sec_seq 0 is the empty first segment.

    exclude names books that are left out. strict_unopened drops books in which a line would be appended before any section is open, as one variant of the procedure fails there.
    """
    pages = elements if pages is None else pages
    if exclude:
        toc = toc.where(~F.col("book").isin(exclude))
    # Outlines are narrow beside the text, and read many times: they are made once, and so are their matches.
    toc = written(toc, "outline")
    good = toc.join(rejected_books(toc), "book", "left_anti")
    if mode == "full":
        return _full(good, elements)
    found = written(owners(hits(written(reachable(good, pages), "reachable"), elements)), "owners")
    choice = F.coalesce(F.nullif(F.col("text_head"), F.lit("")), F.col("text_inline"))
    el = elements.select("book", "page", F.col("seq").alias("el"), choice.alias("text"))
    # What stands before the hit, or all of the page, goes to the open section; then the lines before a line hit do as well.
    prefix = found.join(el, ["book", "page"]).where(F.col("hit").isNull() | (F.col("el") < F.col("hit")))
    missed = found.where("hit is null")
    ln = lines(elements.join(missed.select("book", "page").distinct(), ["book", "page"], "left_semi")).select("book", "page", "line", F.col("text"))
    second = missed.join(ln, ["book", "page"]).where(F.col("line_hit").isNull() | (F.col("line") < F.col("line_hit")))
    if not strict_unopened and missed.isEmpty():
        second = second.limit(0)
    if strict_unopened:
        failing = second.where("owner is null").select("book").distinct()
        found, prefix, second = (x.join(failing, "book", "left_anti") for x in (found, prefix, second))
    content = prefix.select("book", "owner", F.col("seq").alias("a"), F.lit(0).alias("b"), F.col("el").alias("c"), "text").unionByName(second.select("book", "owner", F.col("seq").alias("a"), F.lit(1).alias("b"), F.col("line").alias("c"), "text")).where("owner is not null")
    headings = found.where("opens").select("book", "seq", "level", "heading")
    empty = headings.select("book").distinct().select("book", F.lit(0).alias("sec_seq"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("array<string>").alias("content"))
    return empty.unionByName(_collected(headings, content))


def _full(toc: DataFrame, elements: DataFrame) -> DataFrame:
    """Every element in the section of the last hit at or before it, in reading order; a heading must be contained in the text."""
    found = written(hits(toc, elements, both_ways=False).where("opens"), "opened")
    starts = found.select("book", "page", F.coalesce("hit", "line_hit").alias("el"), "seq", "level", "heading")
    first = starts.groupBy("book", "page", "el").agg(F.min("seq").alias("seq"))  # two headings on one element: the first opens it
    choice = F.coalesce(F.nullif(F.col("text_head"), F.lit("")), F.col("text_inline"))
    marked = elements.select("book", "page", F.col("seq").alias("el"), choice.alias("text")).join(first, ["book", "page", "el"], "left")
    on_page = Window.partitionBy("book", "page").orderBy("el").rowsBetween(Window.unboundedPreceding, 0)
    ends = starts.groupBy("book", "page").agg(F.max_by("seq", F.struct("el", -F.col("seq"))).alias("last"))
    pages = scanned(elements.select("book", "page").distinct().join(ends, ["book", "page"], "left"), ("book",), ("page",), lasts={"carried": F.col("last")}).drop("last")
    owned = marked.withColumn("near", F.last("seq", ignorenulls=True).over(on_page)).join(pages, ["book", "page"]).withColumn("owner", F.coalesce("near", "carried"))
    content = owned.where("owner is not null and seq is null").select("book", "owner", F.col("page").alias("a"), F.lit(0).alias("b"), F.col("el").alias("c"), "text")
    return _collected(starts.select("book", "seq", "level", "heading").join(first.select("book", "seq"), ["book", "seq"], "left_semi"), content)


def unmatched(toc: DataFrame, elements: DataFrame, *, mode: str = "full") -> DataFrame:
    """Entries whose heading was found nowhere on their page. In compat, all entries of a page whose last entry missed."""
    found = hits(written(reachable(toc, elements), "reachable"), elements)
    if mode == "full":
        return found.where("not opens").select("book", "page", "seq", "heading")
    last = found.groupBy("book", "page").agg(F.max_by("opens", "seq").alias("last"))
    return found.join(last.where("not last"), ["book", "page"], "left_semi").select("book", "page", "seq", "heading")

"""Outline files: readers, writers and the bookkeeping of finished and failed books."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.encoding import CharacterModels, Models
from ..runtime import importable


def slug(path: Column, prefix: int = 0) -> Column:
    """The file's name without a 4-character suffix, and without `prefix` characters in front; or the book that its folder names (book=...), null where that is Spark's name for none."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_extract(path, "/book=([^/]+)/[^/]+$", 1)
    return F.when(folder == "__HIVE_DEFAULT_PARTITION__", F.lit(None)).when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.substr(name, F.lit(prefix + 1), F.length(name) - 4 - prefix))


def decoded(rows: DataFrame, models: Models, column: str = "content") -> DataFrame:
    """rows with `text`, `encoding` and `sure` (0 to 1) of a binary column, by models of the encodings; text null where none is possible."""
    importable(rows.sparkSession)

    @F.pandas_udf("text string, encoding string, sure double")
    def found(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([models.decode(None if x is None else bytes(x)) for x in content], columns=["text", "encoding", "sure"])

    return rows.withColumn("d__", found(column)).select(*rows.columns, "d__.text", "d__.encoding", "d__.sure")


def learned_encodings(texts: DataFrame, column: str = "text", *, rows: int = 500, characters: int = 20_000) -> Models:
    """Models of characters from a bounded sample: the `rows` different texts with the smallest hashes, of each the first `characters`."""
    hashed = texts.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h__"), F.substring(column, 1, characters).alias("x__"))
    least = hashed.select("h__").distinct().orderBy("h__").limit(rows).agg(F.max("h__")).first()[0]  # copies of one text count once
    taken = hashed.where(F.col("h__") <= F.lit(least)).groupBy("h__").agg(F.min("x__").alias("x__")).orderBy("h__")
    return CharacterModels([r.x__ for r in taken.collect()])


def files(spark: SparkSession, folder: str, pattern: str, *, single_byte: str | None = None, models: Models | None = None) -> DataFrame:
    """(path, content, encoding_ok) of the files that match, in UTF-8, or in UTF-16 with a byte order mark.

    Any other is read as `single_byte` (such as ISO-8859-1) if that is given, or in the encoding that `models` find, and otherwise has content null and goes to quarantine.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    raw = reader.load(folder).select("path", "content")
    if models:
        return decoded(raw, models).select("path", F.col("text").alias("content"), F.col("text").isNotNull().alias("encoding_ok"))
    start, utf8 = F.hex(F.substring("content", 1, 2)), F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(start.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).when(utf8, F.col("content").cast("string"))
    if single_byte:
        text = text.otherwise(F.decode("content", single_byte))
    body, ok = F.regexp_replace(text, "^\\x{FEFF}", ""), text.isNotNull()
    return raw.select("path", body.alias("content"), ok.alias("encoding_ok"))


def read_naive(spark: SparkSession, folder: str, system: str, *, pattern: str = "*", prefix: int = 0, single_byte: str | None = None, models: Models | None = None) -> DataFrame:
    """(system, book, seq, level, heading_naive): a line is cut at commas, so a heading ends at its first one; cleaned for scoring."""
    lines = files(spark, folder, pattern, single_byte=single_byte, models=models).where("encoding_ok").select(slug(F.col("path"), prefix).alias("book"), F.posexplode(F.split("content", "\n")).alias("seq", "line")).where("line <> ''")
    cut = F.split(F.col("line"), ",")
    return lines.select(F.lit(system).alias("system"), "book", "seq", T.safe_int(F.get(cut, F.lit(0))).alias("level"), T.heading_clean(F.get(cut, F.lit(1))).alias("heading_naive"))


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for book, content in zip(frame["book"], frame["content"], strict=True):
            for seq, row in enumerate(csv.reader(io.StringIO(content or "", newline=""), escapechar="\\")):
                out.append((book, seq, row))
        yield pd.DataFrame(out, columns=["book", "seq", "fields"])


def read_strict(spark: SparkSession, folder: str, system: str, *, pattern: str = "*", prefix: int = 0, single_byte: str | None = None, models: Models | None = None) -> tuple[DataFrame, DataFrame]:
    """(toc, rejects). Records are parsed with a backslash as escape, which drops it; those without exactly 3 fields are rejected.

    One small Arrow function for each file: the escape and quote rules differ from those of Spark's own reader.
    """
    importable(spark)
    found = files(spark, folder, pattern, single_byte=single_byte, models=models).where("encoding_ok").select(slug(F.col("path"), prefix).alias("book"), "content")
    rows = found.mapInPandas(_parsed, "book string, seq int, fields array<string>")
    good = rows.where("size(fields) = 3").select(F.lit(system).alias("system"), "book", "seq", T.safe_int(F.col("fields")[0]).alias("level"), F.col("fields")[1].alias("heading"), T.safe_int(F.col("fields")[2]).alias("page"))
    return good, rows.where("size(fields) <> 3").withColumn("system", F.lit(system))


def _records(content: Column) -> Column:
    """The records of a file's text, each a list of fields."""

    @F.pandas_udf("array<array<string>>")
    def found(content: pd.Series) -> pd.Series:
        return content.map(lambda x: list(csv.reader(io.StringIO(x or "", newline=""), escapechar="\\")))

    return found(content)


def read_shelf(spark: SparkSession, folder: str, system: str, *, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(toc, rejects) as read_strict() gives them, of a folder with a folder book=... for each book, as write_outline_csv() leaves it.

    The book is Spark's partition column and the parser a column function, so a filter on it, or a join with a table of books, reaches the scan, and
    only the files of those books are opened. Files that aren't UTF-8 have rejects without fields; a book without a name has null.
    """
    importable(spark)
    schema = "path string, modificationTime timestamp, length bigint, content binary, book string"
    raw = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", ""))
    rows = raw.select("book", text.alias("text"))
    parsed = rows.where("text is not null").select("book", F.posexplode(_records(F.col("text"))).alias("seq", "fields"))
    good = parsed.where("size(fields) = 3").select(F.lit(system).alias("system"), "book", "seq", T.safe_int(F.col("fields")[0]).alias("level"), F.col("fields")[1].alias("heading"), T.safe_int(F.col("fields")[2]).alias("page"))
    unread = rows.where("text is null").select("book", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("array<string>").alias("fields"))
    return good, parsed.where("size(fields) <> 3").unionByName(unread).withColumn("system", F.lit(system))


def write_outlines(toc: DataFrame, path: str) -> None:
    """One folder for each system; books without entries have no rows and so leave nothing."""
    toc.where(F.col("heading").isNotNull()).write.partitionBy("system").mode("overwrite").parquet(path)


def write_outline_csv(toc: DataFrame, folder: str, *, mark: bool = True) -> None:
    """Outline files: a folder for each book with one file of three-field lines in the order of seq, with a byte order mark in front if `mark`.

    A book's lines are sorted in one task; a book without entries leaves nothing. They are numbered by a window, which keeps a book in one task: a repartition("book") that
    follows a join on the book is left out by Spark as already done, and then the join may be made without dealing by book, so that a book had several files.
    """
    numbered = entry_lines(toc.where(F.col("heading").isNotNull())).withColumn("number__", F.row_number().over(Window.partitionBy("book").orderBy("seq")))
    start = F.when(F.col("number__") == 1, F.lit("\ufeff" if mark else "")).otherwise(F.lit(""))
    numbered.sortWithinPartitions("book", "number__").select("book", F.concat(start, "line").alias("line")).write.partitionBy("book").text(folder)


def write_candidates(rows: DataFrame, folder: str) -> DataFrame:
    """Candidate files without a mark, of the rows that have a level, a heading and a page; returns the rows that were left out."""
    whole = F.col("level").isNotNull() & F.col("heading").isNotNull() & F.col("page").isNotNull()
    write_outline_csv(rows.where(whole), folder, mark=False)
    return rows.where(~whole)


def write_texts(texts: DataFrame, folder: str) -> None:
    """(book, text): responses, errors and other texts as they are, a folder for each book."""
    texts.where(F.col("text").isNotNull()).select("book", "text").write.partitionBy("book").text(folder)


def entry_lines(toc: DataFrame) -> DataFrame:
    """Outline rows as the three-field lines of an outline file, in order."""
    quoted = F.when(F.col("heading").rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace("heading", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("heading"))
    return toc.select("book", "seq", F.concat_ws(",", F.col("level").cast("string"), quoted, F.coalesce(F.col("page").cast("string"), F.lit(""))).alias("line"))


def pending(books: DataFrame, *done: DataFrame) -> DataFrame:
    """Books that are in none of the given tables of finished or failed ones."""
    for d in done:
        books = books.join(d.select("book").distinct(), "book", "left_anti")
    return books


def nth(books: DataFrame, first: int, last: int) -> DataFrame:
    """Books number first to last, without the last, in the order of their names: a part of a long run."""
    return books.select("book").distinct().orderBy("book").offset(first).limit(last - first)

"""Segment and hierarchy files (JSON), and score tables."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable
from .outlines import files, slug

#: Bytes of items or literals that a Python worker gets at once.
BATCH_BYTES = 4 << 20

_SEGMENT = "array<struct<level: int, heading: string, content: array<string>>>"
_ITEMS = "array<struct<level: int, heading: string, content: string>>"


def read_segments(spark: SparkSession, folder: str, system: str, pattern: str = "*.json", prefix: int = 9) -> DataFrame:
    """(system, book, sec_seq, level, heading, content). An empty object, which the first segment may be, keeps its place with nulls."""
    rows = files(spark, folder, pattern).where("encoding_ok").select(F.substr(F.element_at(F.split("path", "/"), -1), F.lit(prefix + 1), F.length(F.element_at(F.split("path", "/"), -1)) - 5 - prefix).alias("book"), F.from_json("content", _SEGMENT).alias("s"))
    return rows.select(F.lit(system).alias("system"), "book", F.posexplode("s").alias("sec_seq", "one")).select("system", "book", "sec_seq", "one.*")


def read_layout(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(book, items) of a layout parser's hierarchy, levels from 0."""
    return files(spark, folder, pattern).where("encoding_ok").select(slug(F.regexp_replace("path", "\\.json$", ".jsn")).alias("book"), F.from_json("content", _ITEMS).alias("items"))


def literal_to_json(text: str) -> str:
    """A hierarchy that was saved as a Python literal, as JSON. Literals only: nothing is evaluated."""
    return json.dumps([{"level": int(a), "heading": b, "content": c} for a, b, c in ast.literal_eval(text)])


def bounded(spark: SparkSession) -> None:
    """Python workers get items by so many bytes at once: a batch by rows alone holds all books of a task."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _literal(items: pd.Series) -> pd.Series:
    return items.map(lambda x: str([(int(r["level"]), r["heading"], r["content"]) for r in (x if x is not None else [])]).replace("\\n", " "))


def write_layout(layout: DataFrame, folder: str) -> None:
    """(book, items) as Python literals, a text file in a folder for each book; line ends inside texts become spaces. literal_to_json reads them."""
    bounded(layout.sparkSession)
    literal = F.pandas_udf(_literal, "string")
    layout.select("book", literal(F.transform("items", lambda r: F.struct(r["level"].alias("level"), r["heading"].alias("heading"), r["content"].alias("content")))).alias("text")).write.partitionBy("book").text(folder)


def read_literals(spark: SparkSession, folder: str) -> DataFrame:
    """(book, items) of the files that write_layout() made."""
    bounded(spark)
    rows = spark.read.schema("value string, book string").text(folder)
    as_json = F.pandas_udf(lambda t: t.map(literal_to_json), "string")
    return rows.select("book", F.from_json(as_json("value"), _ITEMS).alias("items"))


def write_segments(sections: DataFrame, path: str, least: int = 1) -> DataFrame:
    """Writes the books with at least `least` matched headings as JSON rows and returns the rejected books."""
    good = sections.groupBy("book").agg(F.count("heading").alias("n"))
    sections.join(good.where(F.col("n") >= least).select("book"), "book", "left_semi").write.mode("overwrite").json(path)
    return good.where(F.col("n") < least).select("book", F.lit("NO_HEADING_MATCHED").alias("reason"))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("metric").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_dimension(spark: SparkSession, path: str, drop: list[str] | None = None) -> DataFrame:
    """A CSV dimension of books: the named columns go, File becomes the slug in small letters."""
    rows = spark.read.option("header", True).csv(path).drop(*(drop or []))
    return rows.withColumn("book", F.lower(F.expr("substr(File, 1, length(File) - 4)"))).drop("File") if "File" in rows.columns else rows

"""PDF files: conversion by an external tool, and outline entries with their destinations.

Reading a PDF itself is left to a tool or a reader that the caller names; what comes out of it is turned into rows here.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import references
from ..runtime import importable
from .outlines import slug

#: bytes of a PDF -> XML text
Converter = Callable[[bytes], str]


def pdftohtml(content: bytes) -> str:
    """Layout XML of a PDF by the program of that name, through its standard input and output."""
    return subprocess.run(["pdftohtml", "-i", "-xml", "-stdout", "-"], input=content, capture_output=True, check=True, timeout=900).stdout.decode("utf-8", "replace")


def converted(files: DataFrame, convert: Converter = pdftohtml) -> DataFrame:
    """(book, content, problem) of (path, content) rows: one XML text for each PDF. A file that fails gives a row with its problem."""
    importable(files.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for book, content in zip(frame["book"], frame["content"], strict=True):
                try:
                    out.append((book, convert(bytes(content)), None))
                except Exception as e:  # any failure of a foreign program is a row
                    out.append((book, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["book", "content", "problem"])

    return files.select(slug(F.col("path")).alias("book"), "content").mapInPandas(rows, "book string, content string, problem string")


def read_pdfs(spark: SparkSession, folder: str, convert: Converter = pdftohtml) -> DataFrame:
    return converted(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder), convert)


def outline_rows(raw: DataFrame, refs: DataFrame, system: str, stopwords: list[str] | None = None) -> DataFrame:
    """Outline rows (system, book, seq, level, heading, page) from (book, seq, level, title, dest, action, element).

    Titles lose control characters and outer quotes, line ends and spaces; stopwords and empty titles go. The page is that of the first of the three
    references that is there, or null.
    """
    title = T.trim_chain(T.strip_control("title"))
    rows = references.entry_page(raw, refs).withColumn("heading", title).where(F.col("heading") != "").where(T.not_stopword("heading", stopwords or []))
    return rows.select(F.lit(system).alias("system"), "book", "seq", "level", "heading", "page")

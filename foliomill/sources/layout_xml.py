"""Positioned-text XML (pages, text elements, font specifications) to element and fontspec rows.

Mixed content needs the order of text and children, which the built-in XML source loses; so a file is parsed in one Arrow function.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable
from .outlines import files, slug

# Inline tags whose text counts as inline text; fixed values.
INLINE = {"b", "i", "u", "font", "a"}
ROW = "book string, page int, seq int, top int, left int, font_id string, font_size double, bold boolean, italic boolean, text_full string, text_head string, text_inline string, problem string"


def inline_text(node: ET.Element) -> str:
    """Text and tail of inline descendants, stripped and joined by a space; the element's own leading text isn't part of it."""
    parts = []
    for child in node.iter():
        if child.tag in INLINE:
            parts += [x.strip() for x in (child.text, child.tail if child is not node else None) if x]
    return " ".join(p for p in parts if p).strip()


def _number(x: str | None, default: int | None = 0) -> int | None:
    try:
        return int(x) if x is not None else default
    except ValueError:
        return default


def parse(content: str) -> list[dict]:
    root = ET.fromstring(content)
    sizes = {f.get("id"): float(f.get("size") or "nan") for f in root.iter("fontspec")}
    out, page, seq = [], 1, 0
    for node in root.iter():
        if node.tag == "page":
            page, seq = _number(node.get("number"), page), 0
        elif node.tag == "text":
            font = node.get("font")
            out.append({
                "page": page, "seq": seq, "top": _number(node.get("top")), "left": _number(node.get("left")), "font_id": font, "font_size": sizes.get(font),
                "bold": any(c.tag == "b" for c in node), "italic": any(c.tag == "i" for c in node),
                "text_full": "".join(node.itertext()).strip(), "text_head": node.text, "text_inline": inline_text(node),
            })
            seq += 1
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("book", pa.string()), ("page", pa.int32()), ("seq", pa.int32()), ("top", pa.int32()), ("left", pa.int32()), ("font_id", pa.string()), ("font_size", pa.float64()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("text_full", pa.string()), ("text_head", pa.string()), ("text_inline", pa.string()), ("problem", pa.string())])
    for batch in batches:
        for book, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found = [r | {"book": book} for r in parse(content or "")]
            except ET.ParseError as e:
                found = [{"book": book, "problem": str(e)}]
            if found:
                yield pa.RecordBatch.from_pylist(found, kinds)


def elements(books: DataFrame) -> DataFrame:
    """Rows (book, content) to element rows; a file that doesn't parse gives one row with its `problem`."""
    importable(books.sparkSession)
    return books.select("book", "content").mapInArrow(_rows, ROW)


def read_elements(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    return elements(files(spark, folder, pattern).where("encoding_ok").select(slug(F.col("path")).alias("book"), "content"))


def usable(rows: DataFrame) -> DataFrame:
    """Elements with text, in a font that the file specifies."""
    return rows.where((F.col("text_full") != "") & F.col("font_size").isNotNull())


def content_choice():
    """Leading text if there is any, and inline text otherwise."""
    return F.coalesce(F.nullif(F.col("text_head"), F.lit("")), F.col("text_inline"))

"""XLSX workbooks as dimensions: the first sheet's rows under the names of its first row, and back. Only the standard library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable

# Names that the format fixes.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" '
    'Target="{}"/></Relationships>'
)
WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def column_name(k: int) -> str:
    """A, B, ... Z, AA, ... for 0, 1, ..."""
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def workbook(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; numbers are numbers, anything else is text, None is no cell."""
    lines = []
    for n, row in enumerate([tuple(header), *rows], 1):
        cells = []
        for k, v in enumerate(row):
            at = f"{column_name(k)}{n}"
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            elif v is not None and v == v:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", RELATIONS.format("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/workbook.xml", WORKBOOK)
        z.writestr("xl/_rels/workbook.xml.rels", RELATIONS.format("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format("".join(lines)))
    return out.getvalue()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, read one by one: values as they are written, texts whole, None for an empty cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in root.findall(f"{MAIN}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.findall(f"{MAIN}c")):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    out += [None] * (at + 1 - len(out))
                    out[at] = value
                yield out
                row.clear()


def workbooks(rows: DataFrame, by: str) -> DataFrame:
    """(by, content): a workbook for each value of a column, of the other columns' values. A workbook's rows meet in one task."""
    importable(rows.sparkSession)
    names = [c for c in rows.columns if c != by]

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[names].astype(object).where(frame[names].notna(), None)
        return pd.DataFrame([(key[0], workbook(names, list(values.itertuples(index=False, name=None))))], columns=[by, "content"])

    return rows.groupBy(by).applyInPandas(one, f"`{by}` {dict(rows.dtypes)[by]}, content binary")


def dimension(files: DataFrame, columns: list[str], drop: list[str] | None = None) -> DataFrame:
    """(path, columns...) of workbooks (path, content), as texts: the columns of these names, whatever their places; a sheet without one has nulls there.

    The columns in `drop` go, and File becomes `book`: the slug, without a suffix of four characters, in small letters. A file that is no workbook
    has one row with nothing but its path.
    """
    importable(files.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out: list[tuple] = []
                try:
                    rows = sheet_rows(bytes(content))
                    at = {name: k for k, name in enumerate(next(rows, [])) if name is not None}
                    places = [at.get(c, 1 << 30) for c in columns]
                    out = [(path, *(r[k] if k < len(r) else None for k in places)) for r in rows]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
                    out = [(path, *[None] * len(columns))]
                yield pd.DataFrame(out, columns=["path", *columns])

    schema = ", ".join(f"`{c}` string" for c in ["path", *columns])
    found = files.select("path", "content").mapInPandas(read, schema).drop(*(drop or []))
    return found.withColumn("book", F.lower(F.expr("substr(File, 1, length(File) - 4)"))).drop("File") if "File" in found.columns else found


def read_dimension(spark: SparkSession, folder: str, columns: list[str], *, pattern: str = "*.xlsx", drop: list[str] | None = None) -> DataFrame:
    """dimension() of the workbooks below a folder; only files whose names match the pattern are opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return dimension(files, columns, drop)



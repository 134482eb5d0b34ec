"""XLSX workbooks as a data source: `spark.read.format("workbooks")` and `df.write.format("workbooks")`, once register() has made it known.

The scan lists a folder where it is planned, keeps the workbooks that the options name before any is opened, and deals them to partitions by their sizes. A write
stages one file for each workbook, and the commit of the whole job moves them to their places. Filters aren't pushed into the scan: Spark 4.1 keeps what one
use of a DataFrame pushed to a source in Python for its other uses, so that these lose rows; the option `workbooks` chooses instead.

Edge cases: a folder that is missing or has no workbook gives no rows and no columns but the two fixed ones; a file that is no workbook gives one row with its name only;
of columns with one name the first is taken; rows without a name of a workbook aren't written.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..runtime import importable
from .spreadsheets import sheet_rows, workbook

#: How many bytes of (compressed) workbooks a partition gets, unless the option `partition_bytes` says otherwise: some 50,000 rows. A workbook isn't cut.
PARTITION_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def named(path: str) -> str:
    """The name of a workbook, from its file's."""
    return unquote(path.rsplit("/", 1)[-1].removesuffix(".xlsx"))


def listed(path: str, pattern: str = "*.xlsx", names: list[str] | None = None) -> Iterator[fs.FileInfo]:
    """The files below a folder that match the pattern and, if names are given, have one of them. What begins with _ or . is left out."""
    system, root = opened(path)
    wanted = None if names is None else set(names)
    todo = [root]
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if info.base_name[:1] in ("_", "."):
                continue
            if info.type == fs.FileType.Directory:
                todo.append(info.path)
            elif info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, pattern) and (wanted is None or named(info.path) in wanted):
                yield info


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WorkbookReader(DataSourceReader):
    """Deals the workbooks to partitions by their sizes and reads them row by row."""

    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.files = (options.get("pattern", "*.xlsx"), json.loads(options.get("workbooks", "null")))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, cut where the next one would exceed the bytes of a partition."""
        parts: list[list[str]] = []
        room = 0
        for info in sorted(listed(self.folder, *self.files), key=lambda i: i.path):
            if not parts or info.size > room:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(info.path)
            room -= info.size
        return [Files(tuple(p)) for p in parts] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        rows: list[tuple] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                data = f.read()
            for record in self.records(named(path), data):
                rows.append(record)
                if len(rows) == BATCH:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def records(self, name: str, data: bytes) -> Iterator[tuple]:
        nothing = (name, None, *[None] * len(self.columns))
        try:
            rows = sheet_rows(data)
            at = {c: k for k, c in reversed(list(enumerate(next(rows, [])))) if c is not None}
            places = [at.get(c, -1) for c in self.columns]
            for n, r in enumerate(rows):
                yield name, n, *(r[k] if 0 <= k < len(r) else None for k in places)
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
            yield nothing

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("workbook", pa.string()), ("row", pa.int32()), *((c, pa.string()) for c in self.columns)])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Staged(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class WorkbookWriter(DataSourceWriter):
    """A task stages its workbook under a name of its own; only the commit of the whole job moves the files to their places, so that lost or repeated tasks leave nothing."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = options["path"], names, overwrite
        self.job = uuid.uuid4().hex

    def stage(self, root: str) -> str:
        return f"{root.rstrip('/')}/_staged-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        system, root = opened(self.folder)
        system.create_dir(self.stage(root), recursive=True)
        moves = []
        for name, found in groupby((tuple(r) for r in rows), key=lambda r: r[0]):
            staged = f"{self.stage(root)}/{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as f:
                f.write(workbook(self.names, [r[1:] for r in found]))
            moves.append((staged, f"{root.rstrip('/')}/{quote(name, safe=' ')}.xlsx"))
        return Staged(tuple(moves))

    def commit(self, messages: list[Staged]) -> None:
        system, root = opened(self.folder)
        moves = [m for message in messages if message for m in message.moves]
        if len({final for _, final in moves}) < len(moves):
            raise ValueError("a workbook's rows came in several pieces: write_workbooks() brings them together")
        if self.overwrite:
            for info in list(listed(self.folder)):
                system.delete_file(info.path)
        for staged, final in moves:
            system.move(staged, final)
        self.clear(system, root)

    def abort(self, messages: list[Staged]) -> None:
        system, root = opened(self.folder)
        self.clear(system, root)

    def clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self.stage(root)).type == fs.FileType.Directory:
            system.delete_dir(self.stage(root))


class Workbooks(DataSource):
    """(workbook, row, columns...): the rows of the first sheets of workbooks as texts, by the names in their first rows.

    Options: path, pattern (*.xlsx), workbooks (a JSON list of names; all by default), columns (a JSON list; by default those of the first workbook in the order of
    the paths), partition_bytes.
    Written are rows (workbook, columns...), each workbook's in one partition and one after another.
    """

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def columns(self) -> list[str]:
        if given := self.options.get("columns"):
            return json.loads(given)
        first = min((i.path for i in listed(self.options["path"], self.options.get("pattern", "*.xlsx"))), default=None)
        if first is None:
            return []
        system, _ = opened(self.options["path"])
        with system.open_input_stream(first) as f:
            return list(dict.fromkeys(c for c in next(sheet_rows(f.read()), []) if c is not None))

    def schema(self) -> str:
        return ", ".join(["workbook string", "row int", *(f"{quoted(c)} string" for c in self.columns())])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(dict(self.options), schema.fieldNames()[2:])

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema.fieldNames()[1:], overwrite)


def register(spark: SparkSession) -> None:
    """The format becomes known to the session."""
    importable(spark)
    spark.dataSource.register(Workbooks)


def scan_workbooks(spark: SparkSession, folder: str, *, workbooks: list[str] | None = None, columns: list[str] | None = None, pattern: str = "*.xlsx") -> DataFrame:
    """(workbook, row, columns...) of the workbooks below a folder, or of those with the given names only, which alone are opened."""
    register(spark)
    reader = spark.read.format("workbooks").option("pattern", pattern)
    for name, value in (("workbooks", workbooks), ("columns", columns)):
        reader = reader if value is None else reader.option(name, json.dumps(value))
    return reader.load(folder)


def write_workbooks(rows: DataFrame, by: str, folder: str, *, mode: str = "append") -> None:
    """A workbook for each value of a column, of the other columns' values in their order, named by the value. A workbook's rows meet in one task, since they are one file."""
    register(rows.sparkSession)
    key, rest = F.col(quoted(by)), [F.col(quoted(c)) for c in rows.columns if c != by]
    rows.where(key.isNotNull()).select(key.cast("string").alias("workbook"), *rest).repartition("workbook").sortWithinPartitions("workbook").write.format("workbooks").mode(mode).save(folder)

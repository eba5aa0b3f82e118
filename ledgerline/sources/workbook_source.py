"""Workbooks as data sources of Spark: cells by sheet and lines, lists of sheets, and a distributed writer.

    register(spark)
    spark.read.format("workbook").option("sheets", '["Units"]').option("lastRow", 2).load(folder)
    spark.read.format("workbook_lines").load(folder)
    spark.read.format("workbook_sheets").load(folder)
    df.write.format("workbook").mode("overwrite").option("sheet", "Units").save(folder)

Files are opened by the tasks themselves, on file systems that pyarrow reaches: shared folders, hdfs, s3, gs.
Sheets and lines are chosen by options and not by pushed filters: Spark 4.1 keeps what one plan pushed with the DataFrame
that it came from, so a second plan over that DataFrame would miss rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate, chain, groupby, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.schema import spread
from .ooxml import SHEET_ROWS, workbook_cells, workbook_sheets, write_sheet

CELLS = "file string, sheet string, sheet_state string, row_no int, col_no int, value string, formula string, hyperlink string"
CELL = "col_no int, value string, formula string, hyperlink string"
LINES = f"file string, sheet string, sheet_state string, row_no int, cells array<struct<{CELL.replace(' ', ':').replace(',:', ', ')}>>"
SHEETS = "file string, position int, sheet string, sheet_state string"
SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "gs", "gcs")
#: Bytes of files of one task; a workbook that has more is read by a task for each sheet.
SPLIT_BYTES = 4 << 20
#: Files that one task lists the sheets of.
LIST_FILES = 64
#: Cells that a task holds at once, beside a line, the shared strings and a sheet's links.
CELL_ROWS = 20_000
#: Lines that a task holds at once where it reads by lines.
LINE_ROWS = 2_000
#: Lines of a workbook that the writer makes, beyond which it begins the next.
PART_ROWS = 100_000


def scheme(path: str) -> str:
    return m[1] if (m := re.match(r"([A-Za-z][\w+.-]*):", path)) else ""


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path there, what Spark puts before such a path)."""
    if scheme(path) in ("", "file"):
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:(//(?=/))?", "", path)), "file:"
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs, inside, path[: path.index("/", path.index("://") + 3)] if inside.startswith("/") else f"{scheme(path)}://"


def _files(path: str, *endings: str) -> list[tuple[str, int]]:
    """(path, bytes) of files under a folder, or of one file; hidden ones are left out."""
    fs, inside, _ = _store(path)
    info = fs.get_file_info(inside)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inside))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(endings) and not f.base_name.startswith(("_", ".")))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, CELL_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Part(InputPartition):
    """Files of a task; with a sheet's position, that sheet of the one file."""

    files: list[str]
    position: int | None = None


class CellReader(DataSourceReader):
    """Tasks of whole small files, or of one sheet of a large one. Sheets that are not wanted are not opened, and one is left after its last line."""

    def __init__(self, path: str, split: int, sheets: set[str] | None = None, states: set[str] | None = None, first: int = 1, last: int = SHEET_ROWS):
        self.path, self.split, self.sheets, self.states, self.first, self.last = path, split, sheets, states, first, last

    def wanted(self, name: str, state: str) -> bool:
        return (self.sheets is None or name in self.sheets) and (self.states is None or state in self.states)

    def partitions(self) -> list[Part]:
        fs = _store(self.path)[0]
        files = _files(self.path, ".xlsx")
        large = [p for p, n in files if n > self.split]

        def sheets(path):
            with fs.open_input_file(path) as f:
                return [Part([path], k) for k, (name, state) in enumerate(workbook_sheets(f)) if self.wanted(name, state)]

        with ThreadPoolExecutor(16) as pool:
            parts = list(chain.from_iterable(pool.map(sheets, large)))
        room = 0
        for path, n in files:
            if n > self.split:
                continue
            if n > room:
                parts.append(Part([]))
                room = self.split
            parts[-1].files.append(path)
            room -= n
        return parts or [Part([])]

    def cells(self, partition: Part) -> Iterator[tuple]:
        fs, _, head = _store(self.path)

        def wanted(position, name, state):
            return partition.position in (None, position) and self.wanted(name, state)

        for path in partition.files:
            with fs.open_input_file(path) as f:
                for c in workbook_cells(f, wanted, self.first, self.last):
                    yield (head + path, *c)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(self.cells(partition), _schema(CELLS))


class LineReader(CellReader):
    """The same tasks, a row for each line; the cells of a line stand together in a sheet."""

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds, parts = _schema("file string, sheet string, sheet_state string, row_no int"), _schema(CELL)
        lines = ((place, [c[4:] for c in cells]) for place, cells in groupby(self.cells(partition), lambda c: c[:4]))
        while some := list(islice(lines, LINE_ROWS)):
            places = [pa.array(c, t) for c, t in zip(zip(*[p for p, _ in some], strict=True), kinds.types, strict=True)]
            flat = [pa.array(c, t) for c, t in zip(zip(*chain.from_iterable(cells for _, cells in some), strict=True), parts.types, strict=True)]
            ends = pa.array([0, *accumulate(len(cells) for _, cells in some)], pa.int32())
            cells = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, fields=list(parts)))
            yield pa.RecordBatch.from_arrays([*places, cells], names=[*kinds.names, "cells"])


class SheetReader(DataSourceReader):
    """Sheets of workbooks, read from their directories; a CSV file is one sheet without a name."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        files = [p for p, _ in _files(self.path, ".xlsx", ".csv")]
        return [Part(files[k : k + LIST_FILES]) for k in range(0, len(files), LIST_FILES)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _, head = _store(self.path)

        def sheets():
            for path in partition.files:
                if path.lower().endswith(".csv"):
                    yield head + path, 0, None, "visible"
                    continue
                with fs.open_input_file(path) as f:
                    for k, (name, state) in enumerate(workbook_sheets(f)):
                        yield head + path, k, name, state

        return _batches(sheets(), _schema(SHEETS))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class SheetWriter(DataSourceWriter):
    """One workbook or more of each task's rows, under the columns' names.

    Tasks write into a hidden folder of this write; only files of tasks that ended well are moved beside the others, so
    a task that is lost or runs twice leaves nothing. An overwrite then deletes the workbooks that were there before.
    A table without rows is one workbook of its headers.
    """

    def __init__(self, path: str, labels: list[str], sheet: str, part_rows: int, overwrite: bool):
        self.path, self.labels, self.sheet, self.part_rows, self.overwrite = path, labels, sheet, part_rows, overwrite
        self.folder = f".writing-{uuid.uuid4().hex}"

    def _save(self, rows: Iterator) -> Written:
        fs, inside, _ = _store(self.path)
        fs.create_dir(f"{inside}/{self.folder}")
        files, total, head = [], 0, next(rows, None)
        while head is not None or not files:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            with fs.open_output_stream(f"{inside}/{self.folder}/{name}") as out:
                total += write_sheet(out, self.labels, rows if head is None else chain([head], rows), self.sheet, self.part_rows)
            files.append(name)
            head = next(rows, None)
        return Written(files, total)

    def write(self, iterator: Iterator) -> Written:
        first = next(iterator, None)
        return Written([], 0) if first is None else self._save(chain([first], iterator))

    def commit(self, messages: list[Written | None]) -> None:
        fs, inside, _ = _store(self.path)
        fs.create_dir(inside)
        before = [p for p, _ in _files(self.path, ".xlsx")] if self.overwrite else []
        told = [name for m in messages if m for name in m.files] or self._save(iter(())).files
        for name in told:
            fs.move(f"{inside}/{self.folder}/{name}", f"{inside}/{name}")
        for path in before:
            fs.delete_file(path)
        fs.delete_dir(f"{inside}/{self.folder}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, inside, _ = _store(self.path)
        if fs.get_file_info(f"{inside}/{self.folder}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inside}/{self.folder}")


def _schema(ddl: str) -> pa.Schema:
    """The Arrow schema of text and int columns."""
    return pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ddl.split(", ")])


class WorkbookSource(DataSource):
    """Cells of .xlsx files. Options: path, splitBytes, sheets and states (JSON lists; all by default), firstRow, lastRow; to write: sheet, partRows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> CellReader:
        o = self.options
        sheets, states = (set(json.loads(o[k])) if k in o else None for k in ("sheets", "states"))
        return CellReader(o["path"], int(o.get("splitBytes", SPLIT_BYTES)), sheets, states, int(o.get("firstRow", 1)), int(o.get("lastRow", SHEET_ROWS)))

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], schema.names, self.options.get("sheet", "Sheet1"), int(self.options.get("partRows", PART_ROWS)), overwrite)


class WorkbookLines(WorkbookSource):
    """Lines of .xlsx files with their cells in order, by the options of the cells; not written."""

    @classmethod
    def name(cls) -> str:
        return "workbook_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LineReader:
        r = super().reader(schema)
        return LineReader(r.path, r.split, r.sheets, r.states, r.first, r.last)

    def writer(self, schema, overwrite: bool):
        raise NotImplementedError("lines are only read")


class WorkbookSheets(DataSource):
    """Sheets of .xlsx files and CSV files. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "workbook_sheets"

    def schema(self) -> str:
        return SHEETS

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(WorkbookLines)
    spark.dataSource.register(WorkbookSheets)


def sheet_cells(sheets: DataFrame, path: str) -> DataFrame:
    """CELLS of some sheets (file, position) of the workbooks under a path, each read by one row of work."""

    def run(batches):
        fs, _, head = _store(path)
        for batch in batches:
            for file, position in zip(*(batch.column(c).to_pylist() for c in ("file", "position")), strict=True):
                with fs.open_input_file(file.removeprefix(head)) as f:
                    yield from _batches(((file, *c) for c in workbook_cells(f, lambda k, *_: k == position)), _schema(CELLS))  # noqa: B023

    return spread(sheets.select("file", "position")).mapInArrow(run, CELLS)

"""Sheets of workbooks: their cells as tables, headers, listings, and the scan of an upload."""

from __future__ import annotations

import json
import os
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import to_listing
from ..operators.sheets import classify_sheets, sheet_lines
from .mapping import CRITICAL, guess_provider, headers_key, resolve, structural_header
from .ooxml import SHEET_ROWS, workbook_cells, workbook_sheets, write_workbook  # noqa: F401
from . import workbook_source
from .workbook_source import CELL_ROWS, CELLS, SCHEMES, SHEETS, register, scheme


def _load(spark: SparkSession, name: str, path: str, **options) -> DataFrame | None:
    """path by one of the workbook sources, where tasks can open its files; None elsewhere."""
    if scheme(path) not in SCHEMES:
        return None
    register(spark)
    return spark.read.format(name).options(**options).load(path if scheme(path) else os.path.abspath(path))


def read_cells(spark: SparkSession, path: str, sheets: list[str] | None = None, last_row: int | None = None) -> DataFrame:
    """CELLS of all workbooks under a path, or of sheets of some names and of lines up to the last wanted, by sheet.

    In a store that only Hadoop's file systems reach, each file is one row of work, read whole where Spark can read it.
    """
    options = ({} if sheets is None else {"sheets": json.dumps(sheets)}) | ({} if last_row is None else {"lastRow": last_row})
    if (cells := _load(spark, "workbook", path, **options)) is not None:
        return cells
    wanted = None if sheets is None else lambda _, name, state: name in sheets

    def run(batches):
        names = [c.split()[0] for c in CELLS.split(", ")]
        for batch in batches:
            for f, data in zip(batch["path"], batch["content"], strict=True):
                cells = workbook_cells(data, wanted, last=last_row or SHEET_ROWS)
                while rows := [(f, *c) for c in islice(cells, CELL_ROWS)]:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, CELLS)


def as_lines(cells: DataFrame) -> DataFrame:
    """(file, sheet, sheet_state, row_no, cells array<struct<col_no, value, formula, hyperlink>>) of cells."""
    return cells.groupBy("file", "sheet", "sheet_state", "row_no").agg(F.collect_list(F.struct("col_no", "value", "formula", "hyperlink")).alias("cells"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """as_lines of all workbooks under a path, put together where they are read if tasks can open the files."""
    lines = _load(spark, "workbook_lines", path)
    return as_lines(read_cells(spark, path)) if lines is None else lines


def sheet_cells(spark: SparkSession, path: str, sheets: DataFrame) -> DataFrame:
    """CELLS of some sheets (file, position) of the workbooks under a path; others are not opened where tasks can open files."""
    if scheme(path) in SCHEMES:
        return workbook_source.sheet_cells(sheets, path)
    some = list_sheets(spark, path).join(sheets.select("file", "position"), ["file", "position"], "left_semi")
    return read_cells(spark, path).join(some.select("file", "sheet"), ["file", "sheet"], "left_semi")


def formula_fallback(formula):
    """The value that an exported placeholder formula falls back to: text in quotes, or a number."""
    # a fixed format: how exports write formulas that other programs lack
    inner = F.regexp_extract(formula, r"(?s)^=IFERROR\(__xludf\.DUMMYFUNCTION\(.*\),\s*(.+)\)$", 1)
    inner = F.trim(inner)
    quoted = inner.rlike('(?s)^".*"$') & (F.length(inner) >= 2)
    return F.when(inner != "", F.when(quoted, F.replace(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit('""'), F.lit('"'))).otherwise(inner))


def cell_text(links: str = "*", cell=None):
    """A cell's text: its link in every column (links='*') or in none, else its cached value, else the formula's fallback.

    The cell is a row, or a struct of the same names.
    """
    part = F.col if cell is None else cell.__getitem__
    text = F.coalesce(part("value"), formula_fallback(part("formula")))
    return F.coalesce(part("hyperlink"), text) if links == "*" else text


def sheet_table(cells: DataFrame, headers: list[str], header_row: int = 1) -> DataFrame:
    """One sheet's rows under its headers, with _pos; cells of one file and sheet."""
    rows = cells.where(F.col("row_no") > header_row).select("row_no", "col_no", cell_text().alias("t"))
    wide = rows.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "t"))).alias("m"))
    return wide.select(F.col("row_no").cast("long").alias("_pos"), *[F.col("m")[F.lit(k + 1)].alias(h) for k, h in enumerate(headers)])


def sheet_headers(cells: DataFrame, header_row: int = 1) -> list[str]:
    """Header texts by column; a blank one reads `column n`."""
    rows = {r["col_no"]: r["t"] for r in cells.where(F.col("row_no") == header_row).select("col_no", cell_text("").alias("t")).collect()}
    return [str(rows.get(k) or f"column {k}") for k in range(1, max(rows, default=0) + 1)]


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, sheet, sheet_state) of all workbooks under a path, empty sheets included; a CSV file is one sheet without a name."""
    if (sheets := _load(spark, "workbook_sheets", path)) is not None:
        return sheets

    def run(batches):
        for batch in batches:
            rows = [(f, k, *s) for f, data in zip(batch["path"], batch["content"], strict=True) for k, s in enumerate([(None, "visible")] if f.lower().endswith(".csv") else workbook_sheets(data))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHEETS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,csv}").load(path).select("path", "content")
    return files.mapInPandas(run, SHEETS)


def read_listing(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """Listing rows of one sheet that this engine wrote, under whatever order its columns have.

    Each column is known by its own header; columns of no field go, missing ones are null. The
    brochure link is the cell's link and not its text.
    """
    headers = sheet_headers(cells, header_row)
    return to_listing(sheet_table(cells, headers, header_row))


def scan_upload(spark: SparkSession, path: str, rescues: dict[str, dict] | None = None, checkpoint=None) -> DataFrame:
    """One row for each sheet of the workbooks under a path: (file, sheet, sheet_state, headers, header_hash, mapping,
    unresolved, provider, area, outcome, reasons). provider is what the file's name says, area the structural header.

    A sheet whose headers settle all critical fields, perhaps with a kept rescue (by header hash), has
    no outcome; the others are classified, by their own lines and the dates of the file's other
    unresolved sheets. Headers come from each sheet's first row. Of settled sheets no more is read.
    checkpoint(df, name) keeps the headers and the lines of doubtful sheets, which are read more than once.
    """
    keep = checkpoint or (lambda df, name: df)
    head = read_cells(spark, path, last_row=1).where("row_no = 1").select("file", "sheet", "col_no", cell_text("").alias("t"))
    head = head.groupBy("file", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "t"))).alias("m"))
    names = F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("m")).cast("int")), lambda k: F.coalesce(F.nullif(F.col("m")[k], F.lit("")), F.concat(F.lit("column "), k.cast("string"))))
    head = head.select("file", "sheet", names.alias("headers"))

    def run(batches):
        for batch in batches:
            rows = []
            for file, sheet, headers in zip(batch["file"], batch["sheet"], batch["headers"], strict=True):
                names = list(headers)
                mapping, open_ = resolve(names, file.rsplit("/", 1)[-1], rescues)
                base = file.rsplit("/", 1)[-1]
                rows.append((file, sheet, names, {h: f for h, f in mapping.items() if f}, open_, guess_provider(base), structural_header(names, base)))
            yield pd.DataFrame(rows, columns=["file", "sheet", "headers", "mapping", "unresolved", "provider", "area"])

    found = head.mapInPandas(run, "file string, sheet string, headers array<string>, mapping map<string,string>, unresolved array<string>, provider string, area string")
    found = found.withColumn("header_hash", headers_key("headers"))
    every = list_sheets(spark, path).where("sheet is not null").join(found, ["file", "sheet"], "left")
    every = every.withColumn("unresolved", F.coalesce("unresolved", F.array(*map(F.lit, CRITICAL))))
    every = keep(every, "headers")
    doubtful = every.where(F.size("unresolved") > 0).select("file", "position", "sheet", "sheet_state")
    lines = keep(sheet_lines(sheet_cells(spark, path, doubtful).withColumn("value", cell_text(""))), "doubtful")
    told = classify_sheets(doubtful, lines).select("file", "sheet", "outcome", "reasons")
    return every.join(told, ["file", "sheet"], "left").select("file", "position", "sheet", "sheet_state", "headers", "header_hash", "mapping", "unresolved", "provider", "area", "outcome", "reasons")

"""From the files of an upload to staged rows: scan, mapping, area, provider, coordinates and addresses in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import KINDS, LISTING, is_blank
from ..functions.text import coerce_number
from ..operators.geocode import geocode_rows
from ..sources.documents import content_hash
from ..sources.mapping import fill_blank
from ..sources.xlsx import as_lines, cell_text, read_lines, scan_upload
from .checkpoints import numbered
from .table import Staging


def mapped_rows(cells: DataFrame, scan: DataFrame) -> DataFrame:
    """(file, sheet, position, row_no, provider_guess, area, listing columns): rows of all sheets whose headers settle every critical field.

    cells: lines of workbooks, or their cells, which are put together first. Each cell is known by its column's header, the
    first of equal ones; numbers are coerced, and rows without a building go. All sheets of all files are one join.
    """
    lines = cells if "cells" in cells.columns else as_lines(cells)
    fields = F.filter(F.transform("headers", lambda h, k: F.struct((k + 1).alias("col_no"), F.when(F.array_position("headers", h) == k + 1, F.col("mapping")[h]).alias("field"))), lambda x: x["field"].isin(list(KINDS)))
    sheets = scan.where("size(unresolved) = 0").select("file", "sheet", "position", F.col("provider").alias("provider_guess"), "area", F.map_from_entries(fields).alias("fields"))
    told = lines.where("row_no > 1").select("file", "sheet", "row_no", "cells").join(sheets, ["file", "sheet"])
    named = F.filter("cells", lambda c: F.map_contains_key("fields", c["col_no"]))
    rows = told.select("file", "sheet", "position", "row_no", "provider_guess", "area", F.map_from_entries(F.transform(named, lambda c: F.struct(F.col("fields")[c["col_no"]].alias("field"), cell_text(cell=c).alias("t")))).alias("m"))
    cols = []
    for f, kind in KINDS.items():
        c = F.element_at(F.split("file", "/"), -1) if f == "source_file" else F.try_element_at("m", F.lit(f))
        cols.append((c if kind == "str" else coerce_number(c, kind)).cast(LISTING[f].dataType).alias(f))
    return rows.select("file", "sheet", "position", "row_no", "provider_guess", "area", *cols).where(~is_blank(F.col("building")))


def upload_rows(spark: SparkSession, path: str, checkpoint, rescues: dict[str, dict] | None = None, responses: DataFrame | None = None) -> DataFrame:
    """(file, listing columns, _pos): rows of the workbooks under a path that wait for no decision, in the order of files, sheets and lines.

    A blank provider is guessed from the file's name and a blank submarket is the area that a known export's header names;
    then coordinates are looked up in `responses`, which never override them, and a blank address is a building with a
    number. Sheets that are unresolved are scan_upload's to tell; rescues (by header hash) settle them.
    """
    scan = checkpoint(scan_upload(spark, path, rescues, checkpoint), "scan")
    rows = mapped_rows(read_lines(spark, path), scan)
    rows = rows.withColumn("provider", fill_blank("provider", F.col("provider_guess")))
    rows = rows.withColumns({"internal_ref": fill_blank("internal_ref", F.col("provider")), "submarket": fill_blank("submarket", F.col("area"))})
    rows = checkpoint(rows.drop("provider_guess", "area"), "mapped")
    rows = numbered(rows, ["file", "position", "row_no"], "_pos", checkpoint).select("file", *KINDS, "_pos")
    if responses is not None:
        rows = geocode_rows(rows, responses, checkpoint=checkpoint).drop("failure")
    return rows.withColumn("address_1", fill_blank("address_1", F.when(F.col("building").rlike(r"\d"), F.col("building"))))


def stage_uploads(spark: SparkSession, path: str, staging: Staging, checkpoint, rescues: dict[str, dict] | None = None, responses: DataFrame | None = None, logic: str = "1") -> dict[str, str]:
    """Save each file of an upload as a batch of its own: {file name: batch}, for files that no kept batch has the content of.

    The few files of an upload are taken one after the other; their rows come from one table.
    """
    rows = checkpoint(upload_rows(spark, path, checkpoint, rescues, responses), "upload")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.col("path").alias("file"), content_hash(F.col("content"), logic).alias("hash"))
    known = {r["content_hash"] for r in staging.batches().where("content_hash is not null").select("content_hash").distinct().collect()}
    out = {}
    for r in files.join(rows.select("file").distinct(), "file").orderBy("file").collect():
        if r["hash"] not in known:
            known.add(r["hash"])
            name = r["file"].rpartition("/")[2]
            out[name] = staging.save(rows.where(F.col("file") == r["file"]).drop("file"), name, r["hash"])
    return out

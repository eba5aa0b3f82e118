"""Queries over what the library stores: versions of the master, staged batches, written workbooks read as an upload."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.schema import KINDS, title_label
from ..plans.checkpoints import shared_folder, writer
from ..plans.table import MasterTable, Staging
from ..plans.upload import mapped_rows
from ..sources.workbook_source import register
from ..sources.xlsx import read_lines, scan_upload
from .adapter import sides, with_listing

QUERIES, ORACLES = {}, {}
UPDATES = "_pos long, field string, value string"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}"


def _by_provider(name: str, source: str, rows: str) -> str:
    return f"SELECT {name} AS version, '{source}' AS source, (SELECT count(*) FROM {rows}) AS row_count, provider, count(*) AS n, sum(size_sqft) AS size FROM {rows} GROUP BY provider"


@query(with_listing(" UNION ALL ".join([_by_provider("1", "first", "master"), _by_provider("2", "batch", "listing"), _by_provider("3", "undo", "master")])))
def master_versions(spark, sf):
    """Every version of a master that is written, gets a batch's rows and is restored, from its log and its files."""
    table, checkpoint = MasterTable(spark, _folder(spark)), writer(spark)
    batch, master = sides(spark, sf, checkpoint)
    first = table.write(master, "first")
    table.merge(lambda _: (spark.createDataFrame([], UPDATES), batch, None), checkpoint, "batch")
    table.restore(first, "undo")
    out = None
    for path in (r["version_path"] for r in table.versions().select("version_path").collect()):  # three versions
        rows = table.read(path).groupBy("provider").agg(F.count("*").alias("n"), F.sum("size_sqft").alias("size")).withColumn("version_path", F.lit(path))
        out = rows if out is None else out.unionByName(rows)
    number = F.regexp_extract("version_path", r"(\d+)\.json$", 1).cast("int")
    return out.join(table.versions(), "version_path").select(number.alias("version"), "source", "row_count", "provider", "n", "size")


@query(with_listing("SELECT pos, building, floor_unit, provider, CASE WHEN pos // 10 % 4 = 0 THEN 'zero' ELSE 'one' END AS staged FROM batch WHERE pos // 10 % 4 < 2"))
def staged_rows(spark, sf):
    """Rows that wait for approval, of four staged batches of which one is approved and one thrown away."""
    batch, _ = sides(spark, sf)
    kept = writer(spark)(batch, "batch")
    staging = Staging(spark, _folder(spark))
    names = [staging.save(kept.where(f"_pos div 10 % 4 = {k}"), f"{name}.xlsx", f"hash {k}") for k, name in enumerate(("zero", "one", "two", "three"))]
    staging.approve(names[2])
    staging.discard(names[3])
    pending = staging.pending().select(F.regexp_extract("filename", "[a-z]+", 0).alias("staged"), "content_hash")
    rows = staging.union().withColumn("content_hash", F.concat(F.lit("hash "), F.expr("_pos div 10 % 4").cast("string")))
    return rows.join(pending, "content_hash").select(F.col("_pos").alias("pos"), "building", "floor_unit", "provider", "staged")


@query(with_listing("SELECT building, floor_unit, provider, postcode, size_sqft, rent_pcm, count(*) AS n FROM batch GROUP BY ALL"))
def workbook_upload(spark, sf):
    """A batch written as workbooks under a listing's labels, then scanned, mapped and read as an upload."""
    batch, _ = sides(spark, sf)
    register(spark)
    path = _folder(spark)
    batch.select(*[F.col(c).alias(title_label(c)) for c in KINDS if c not in ("source_file", "property_id")]).write.format("workbook").mode("append").save(path)
    checkpoint = writer(spark)
    scan = checkpoint(scan_upload(spark, path, checkpoint=checkpoint), "scan")
    rows = mapped_rows(read_lines(spark, path), scan)
    return rows.groupBy("building", "floor_unit", "provider", "postcode", "size_sqft", "rent_pcm").agg(F.count("*").alias("n"))

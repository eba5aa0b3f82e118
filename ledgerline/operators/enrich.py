"""Filling blank descriptions from the units of a linked brochure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import is_blank
from ..functions.text import normalize_key
from .links import is_generic_link

ENRICHABLE = ["special_features", "state_of_space"]
# What a brochure's address does not hold.
REJECTED_URLS = ["floorplan", "floor-plan", "youtube.com", "youtu.be"]


def eligible_url(c):
    """Whether a link may be a brochure, from its text alone."""
    bad = F.lower(c).rlike("|".join(x.replace(".", r"\.") for x in REJECTED_URLS))
    return F.coalesce(c.rlike("^(?i)https?:") & ~is_generic_link(c) & ~bad, F.lit(False))


def needs_enrichment(fields=ENRICHABLE):
    out = F.lit(False)
    for f in fields:
        out = out | is_blank(F.col(f))
    return out


def match_units(rows: DataFrame, units: DataFrame, row_id: str = "_pos") -> DataFrame:
    """(row_id, unit): the brochure unit of each row: its link's sole unit of that building, else of that floor, else of about that size.

    units: url, building, floor_unit, size_sqft and what to fill. Sizes agree within 2 % or 1 sq ft.
    A tier with several candidates gives way to the next, as one without any does.
    """
    u = units.select("url", normalize_key(F.col("building")).alias("_b"), normalize_key(F.col("floor_unit")).alias("_uf"), F.col("size_sqft").alias("_us"), F.struct(*units.columns).alias("unit"))
    r = rows.select(row_id, F.col("brochure_link").alias("url"), normalize_key(F.col("building")).alias("_b"), F.when(F.col("floor_unit") != "", normalize_key(F.col("floor_unit"))).alias("_f"), F.col("size_sqft").alias("_s")).where("_b <> ''")
    pairs = r.join(u, ["url", "_b"])
    floor = F.col("_f") == F.col("_uf")
    size = (F.col("_s") != 0) & (F.col("_us") != 0) & (F.abs(F.col("_us") - F.col("_s")) <= F.greatest(F.lit(1.0), 0.02 * F.col("_s")))
    found = pairs.groupBy(row_id).agg(
        F.count("*").alias("n"), F.first("unit").alias("one"), F.count_if(floor).alias("nf"), F.max(F.when(floor, F.struct(F.lit(1), "unit")))["unit"].alias("by_floor"), F.count_if(size).alias("ns"), F.max(F.when(size, F.struct(F.lit(1), "unit")))["unit"].alias("by_size")
    )
    unit = F.when(F.col("n") == 1, F.col("one")).when(F.col("nf") == 1, F.col("by_floor")).when(F.col("ns") == 1, F.col("by_size"))
    return found.select(row_id, unit.alias("unit")).where("unit is not null")


def enrich(rows: DataFrame, units: DataFrame, row_id: str = "_pos") -> DataFrame:
    """rows with blank ENRICHABLE fields filled, and `enriched`, the fields that were."""
    asks = rows.where(needs_enrichment() & eligible_url(F.col("brochure_link")))
    out = rows.join(match_units(asks, units, row_id), row_id, "left")
    fill = {f: is_blank(F.col(f)) & ~is_blank(F.col(f"unit.{f}")) for f in ENRICHABLE}
    out = out.withColumn("enriched", F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in fill.items()])))
    for f in ENRICHABLE:
        out = out.withColumn(f, F.when(F.array_contains("enriched", f), F.col(f"unit.{f}")).otherwise(F.col(f)))
    return out.drop("unit")

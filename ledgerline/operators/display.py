"""What a reviewer sees: order, hidden columns, search and export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import LINEAGE_FIELDS, is_blank, title_label
from ..functions.text import normalize_key



def provider_order(pos: str = "_pos") -> list[Column]:
    """By provider without case, rows without one last, then as they came."""
    return [F.col("provider").isNull(), F.lower("provider"), F.col(pos)]


def visible_columns(rows: DataFrame) -> list[str]:
    """All columns but lineage; desks_min goes if no row has one."""
    hidden = set(LINEAGE_FIELDS)
    if "desks_min" in rows.columns and rows.where("desks_min is not null").isEmpty():
        hidden.add("desks_min")
    return [c for c in rows.columns if c not in hidden]


def restore_hidden(edited: DataFrame, original: DataFrame, pos: str = "_pos") -> DataFrame:
    """edited rows with the columns that were hidden, in the original order."""
    missing = [c for c in original.columns if c not in edited.columns]
    return edited.join(original.select(pos, *missing), pos, "left").select(*original.columns)


def search(rows: DataFrame, pattern: str, columns: list[str], literal: bool = False) -> DataFrame:
    """Rows in which one of the columns matches a regular expression somewhere, without case.

    White space around the pattern goes; columns that rows do not have are left out; an empty pattern
    matches all. With literal, or if it is no regular expression, the pattern is text.
    """
    pattern = pattern.strip()
    try:
        re.compile(pattern)
    except re.error:
        literal = True
    hit = F.lit(False)
    for c in [c for c in columns if c in rows.columns]:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        hit = hit | (F.contains(F.lower(value), F.lit(pattern.lower())) if literal else value.rlike(f"(?iu){pattern}"))
    return rows.where(hit)


def property_labels(rows: DataFrame) -> DataFrame:
    """(pos, label): address and provider, and the floor where rows share an address."""
    shown = F.when(is_blank(F.col("address_1")), F.lit("(no address)")).otherwise(F.col("address_1"))
    keyed = rows.withColumn("_a", normalize_key(F.col("address_1")))
    many = keyed.groupBy("_a").agg(F.count("*").alias("_n"))
    floor = F.when((F.col("_n") > 1) & ~is_blank(F.col("floor_unit")), F.col("floor_unit"))
    return keyed.join(many, "_a").select("_pos", F.concat_ws(" — ", shown, F.when(~is_blank(F.col("provider")), F.col("provider")), floor).alias("label"))


def export_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen properties (property_id) under their labels, without lineage."""
    kept = rows.join(chosen.select("property_id").distinct(), "property_id", "left_semi").orderBy(*provider_order())
    return kept.select(*[F.col(c).alias(title_label(c)) for c in visible_columns(rows) if not c.startswith("_")])

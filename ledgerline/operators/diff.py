"""Field-level differences between a master row and the batch row that matched it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DIFF_FIELDS, KINDS, is_blank
from ..functions.text import detail_loss, house_number_changed, mentions_let_status, richness_regression, values_equal

RISKY_TEXT = ["special_features", "contacts"]
HOUSE_NUMBER_FIELDS = ["address_1", "building"]
LET_FIELDS = ["special_features", "state_of_space"]


def field_diffs(old: Column, new: Column, fields: list[str] = DIFF_FIELDS) -> Column:
    """Array of (field, old, new) for fields whose new value is not blank and differs beyond formatting."""
    out = []
    for f in fields:
        a, b, kind = old[f], new[f], KINDS[f]
        changed = ~is_blank(b, kind) & (is_blank(a, kind) | ~values_equal(a, b, kind))
        out.append(F.when(changed, F.struct(F.lit(f).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))))
    return F.array_compact(F.array(*out))


def silent_updates(old: Column, new: Column, fields: list[str] = DIFF_FIELDS) -> Column:
    """Map of text fields that differ in formatting only."""
    out = []
    for f in fields:
        if KINDS[f] == "str":
            a, b = old[f], new[f]
            same = ~is_blank(a) & ~is_blank(b) & values_equal(a, b) & (a != b)
            out.append(F.when(same, F.struct(F.lit(f).alias("field"), b.alias("new"))))
    return F.map_from_entries(F.array_compact(F.array(*out)))


def risky_fields(old: Column, new: Column, diffs: Column) -> Column:
    """Changed fields that lose detail, shrink, or change a house number."""
    named = F.transform(diffs, lambda d: d["field"])
    checks = [(f, detail_loss(old[f], new[f]) | richness_regression(old[f], new[f])) for f in RISKY_TEXT]
    checks += [(f, house_number_changed(old[f], new[f])) for f in HOUSE_NUMBER_FIELDS]
    return F.array_compact(F.array(*[F.when(F.array_contains(named, f) & c, F.lit(f)) for f, c in checks]))


def let_status_fields(new: Column, diffs: Column) -> Column:
    """Changed descriptive fields whose new value says that the unit has gone."""
    named = F.transform(diffs, lambda d: d["field"])
    return F.array_compact(F.array(*[F.when(F.array_contains(named, f) & mentions_let_status(new[f]), F.lit(f)) for f in LET_FIELDS]))


def diff_matches(matches: DataFrame, batch_columns: list[str]) -> DataFrame:
    """matches (batch columns, match_tier, master) with new, diffs, silent_updates, risky_fields, let_status_fields and changed."""
    out = matches.where("match_tier is not null").withColumn("new", F.struct(*batch_columns)).drop(*batch_columns)
    out = out.withColumn("diffs", field_diffs(F.col("master"), F.col("new")))
    return out.withColumns(
        {
            "silent_updates": silent_updates(F.col("master"), F.col("new")),
            "risky_fields": risky_fields(F.col("master"), F.col("new"), F.col("diffs")),
            "let_status_fields": let_status_fields(F.col("new"), F.col("diffs")),
            "changed": F.size("diffs") > 0,
        }
    )

"""Conflicts within a batch: several rows for one master row, and duplicates among new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DIFF_FIELDS, KINDS, is_blank
from ..functions.text import house_number, street_key, tolerant_text
from .match import KEYS, with_keys


#: Numbers that differ by less are equal.
NUMBER_GAP = 1e-6


def _several(c: Column, kind: str, pos: str) -> Column:
    """Of a group: whether its values that are not blank are two classes or more.

    Texts are of one class if they differ in formatting only. A number is of the class of the first one, by
    pos, that is nearer than NUMBER_GAP, so there is a second class if the least or the greatest number is
    that far from the first of all: no number is rounded, and no class is collected.
    """
    told = F.when(~is_blank(c, kind), tolerant_text(c) if kind == "str" else c)
    if kind == "str":
        return F.coalesce(F.min(told) != F.max(told), F.lit(False))
    first = _least_by_pos(c, pos, ~is_blank(c, kind))
    far = F.greatest(F.max(told) - first, first - F.min(told)) >= NUMBER_GAP
    return F.coalesce(far & (F.count(told) > 1), F.lit(False))


def _least_by_pos(c: Column, pos: str, keep: Column) -> Column:
    return F.min_by(F.when(keep, c), F.when(keep, F.col(pos)))


def field_choices(rows: DataFrame, group: str, fields: list[str], pos: str = "_pos", blanks_count: bool = False) -> DataFrame:
    """(group, field, needs_choice, value, default): what the rows of each group say about each field.

    Texts agree when they differ in formatting only, numbers when they are nearer than NUMBER_GAP to the first. Blanks have no say, or are a class of their own
    with blanks_count. needs_choice is set for two classes or more; value is the first of the only
    class; default is the sole non-blank value, else the first row's.
    """
    parts = []
    for f in fields:
        kind = KINDS[f]
        c, blank = F.col(f), is_blank(F.col(f), kind)
        # told from the least and the greatest: no distinct counts, so rows are not expanded
        several = _several(c, kind, pos)
        if blanks_count:
            several = several | (F.bool_or(blank) & F.bool_or(~blank))
        text = c.cast("string")
        some = F.count_if(~blank)
        first = F.min_by(text, F.col(pos))
        sole = _least_by_pos(text, pos, ~blank)
        parts.append(F.struct(F.lit(f).alias("field"), several.alias("needs_choice"), F.when(~several, sole).alias("value"), F.when(some == 1, sole).otherwise(first).alias("default")))
    return rows.groupBy(group).agg(F.array(*parts).alias("_f")).select(group, F.explode("_f").alias("_f")).select(group, "_f.*")


def collisions(diffed: DataFrame, master_pos: str = "_pos") -> DataFrame:
    """(master_pos, n, fields): master rows that two or more changed rows want to update, and all their fields in schema order."""
    changed = diffed.where("changed").select(F.col("master")[master_pos].alias("master_pos"), F.transform("diffs", lambda d: d["field"]).alias("f"))
    groups = changed.groupBy("master_pos").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("f"))).alias("f")).where("n > 1")
    order = F.array(*map(F.lit, DIFF_FIELDS))
    return groups.select("master_pos", "n", F.filter(order, lambda x: F.array_contains("f", x)).alias("fields"))


def duplicate_keys(rows: DataFrame, pos: str = "_pos") -> DataFrame:
    """(pos, match keys, k_postcode, street, number): what rows may be duplicates by. Rows that have the match keys need only building beside."""
    rows = rows if {*KEYS, "k_postcode"} <= {*rows.columns} else with_keys(rows)
    found = {"street": street_key(F.col("building")), "number": house_number(F.col("building"))}
    return rows.withColumns(found).select(pos, *KEYS, "k_postcode", "street", "number")


def duplicate_edges(keys: DataFrame, pos: str = "_pos") -> DataFrame:
    """(a, b) of duplicate_keys: each row to the first of its group, over equal keys and over streets without a contradiction.

    Rows are alike under the match key with the postcode, or without one if they have none. Rows of
    one street, provider and floor are alike if the whole group names at most one house number and
    at most one postcode.
    """
    k = keys.withColumns({"p": F.coalesce("k_postcode", F.lit("")), "q": F.col("k_postcode").isNull()})
    exact = k.groupBy(*KEYS, "p", "q").agg(F.min(pos).alias("a"), F.count("*").alias("n")).where("n > 1")
    by_key = k.join(exact, [*KEYS, "p", "q"]).select("a", F.col(pos).alias("b"))
    group = ["street", "k_provider", "k_floor"]
    s = keys.where("street <> ''")
    # at most one value: the least is the greatest
    fine = s.groupBy(*group).agg(F.min(pos).alias("a"), F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("number", "k_postcode") for f in (F.min, F.max)])
    fine = fine.where("n > 1 and coalesce(min_number = max_number, true) and coalesce(min_k_postcode = max_k_postcode, true)").select(*group, "a")
    by_street = s.join(fine, group).select("a", F.col(pos).alias("b"))
    return by_key.union(by_street).where("a <> b").distinct()


def connected(edges: DataFrame, checkpoint, rounds: int = 60) -> DataFrame:
    """(id, component) by rounds of smallest labels with pointer jumping; checkpoint(df, name) cuts the lineage.

    A round is one written table. Chains of labels halve in each, so rounds grow with the logarithm of
    a component's width; more than `rounds` are an error.
    """
    edges = checkpoint(edges.select("a", "b"), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(rounds):
        told = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(told, "a").select("a", F.least("label", "near").alias("low"), F.col("label").alias("before"))
        jump = labels.select(F.col("a").alias("low"), F.col("label").alias("next"))
        new = checkpoint(new.join(jump, "low").select("a", F.least("low", "next").alias("label"), "before"), "labels")
        if new.where("label <> before").isEmpty():
            return new.select(F.col("a").alias("id"), F.col("label").alias("component"))
        labels = new.select("a", "label")
    raise RuntimeError("components did not settle")


def duplicate_groups(rows: DataFrame, checkpoint, pos: str = "_pos") -> DataFrame:
    """(pos, component) of new rows that are duplicates of each other; component is the first row's position."""
    keys = checkpoint(duplicate_keys(rows, pos), "duplicate_keys")
    return connected(duplicate_edges(keys, pos), checkpoint).withColumnRenamed("id", pos)

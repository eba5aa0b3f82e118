"""The plan of a batch against the master as DataFrames, the default decisions, and their application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DIFF_FIELDS, KINDS, LISTING, is_blank
from ..functions.text import digit_free, row_label
from ..operators.diff import diff_matches
from ..operators.match import match_batch, suggest_similar
from ..operators.resolve import collisions, duplicate_groups, field_choices
from ..operators.stale import stale_candidates

COLUMNS = list(KINDS)


@dataclass
class MergePlan:
    """matched: diffed matches with the master's struct; unmatched: new rows; both carry the batch position _pos."""

    master: DataFrame
    batch: DataFrame
    matched: DataFrame
    unmatched: DataFrame
    collisions: DataFrame
    duplicates: DataFrame
    suggestions: DataFrame
    stale: DataFrame


def _made_id() -> Column:
    keys = [F.coalesce(c, F.lit("")) for c in ("building", "provider", "floor_unit", "postcode")]
    return F.substring(F.sha2(F.concat_ws("␟", F.col("_pos").cast("string"), *keys), 256), 1, 32)


def backfill_ids(rows: DataFrame) -> DataFrame:
    """rows with a property_id wherever it is blank, from the row's position and keys, so that a rerun agrees."""
    return rows.withColumn("property_id", F.when(is_blank(F.col("property_id")), _made_id()).otherwise(F.col("property_id")))


def missing_ids(master: DataFrame) -> DataFrame:
    """Updates (_pos, field, value) that give rows without a property_id the one that backfill_ids makes."""
    return master.where(is_blank(F.col("property_id"))).select("_pos", F.lit("property_id").alias("field"), _made_id().alias("value"))


def build_plan(batch: DataFrame, master: DataFrame, checkpoint, fully_occupied: DataFrame | None = None) -> MergePlan:
    """batch and master: listing columns and a distinct _pos each. checkpoint(df, name) writes and rereads a table."""
    master, batch = backfill_ids(master), batch.select(*COLUMNS, "_pos")
    named = batch.withColumnRenamed("_pos", "_batch_pos")
    matches = checkpoint(match_batch(named, master, checkpoint=checkpoint), "matches")
    matched = checkpoint(diff_matches(matches, COLUMNS), "matched")
    unmatched = matches.where("match_tier is null").select(*COLUMNS, F.col("_batch_pos").alias("_pos"))
    stale = stale_candidates(batch, master, matched.select(F.col("master._pos").alias("_pos")), "_pos", fully_occupied)
    return MergePlan(master, batch, matched, unmatched, collisions(matched), duplicate_groups(unmatched, checkpoint), suggest_similar(unmatched, master), stale)


def default_updates(plan: MergePlan, decisions: DataFrame | None = None) -> DataFrame:
    """(_pos, field, value) for the master, as if a reviewer approved what is shown.

    Rows that say a unit has gone apply all their diffs. Other changed rows apply what is not risky;
    rows that collide apply a field only if they agree on it or one of them alone states it. The
    source file goes along, and formatting-only updates stand under explicit ones. decisions
    (_pos, field, value, approved) override: approved rows are applied, others are dropped.
    """
    m = plan.matched.withColumn("_pos", F.col("master._pos")).join(plan.collisions.select(F.col("master_pos").alias("_pos"), F.col("n").alias("_rivals")), "_pos", "left")
    let = F.size("let_status_fields") > 0
    rows = m.where("changed").withColumn("_let", let)
    single = rows.where("_let or _rivals is null").select("_pos", "_let", "risky_fields", F.explode("diffs").alias("d"), F.lit(2).alias("rank"), "_batch_pos")
    single = single.where("_let or not array_contains(risky_fields, d.field)").select("_pos", F.col("d.field").alias("field"), F.col("d.new").alias("value"), "rank", "_batch_pos")
    rivals = rows.where("not _let and _rivals is not null").select("_pos", F.col("_batch_pos"), "new.*")
    agreed = field_choices(rivals.drop("_let"), "_pos", [f for f in DIFF_FIELDS], "_batch_pos")
    named = rows.where("not _let and _rivals is not null").select("_pos", F.explode("diffs").alias("d"), "risky_fields").select("_pos", F.col("d.field").alias("field"), F.array_contains("risky_fields", F.col("d.field")).alias("risky"))
    named = named.groupBy("_pos", "field").agg(F.bool_or("risky").alias("risky")).where("not risky")
    group = agreed.join(named, ["_pos", "field"]).select("_pos", "field", F.coalesce("value", "default").alias("value"), F.lit(2).alias("rank"), F.lit(0).cast("long").alias("_batch_pos")).where("value is not null")
    silent = m.select("_pos", F.explode("silent_updates").alias("field", "value"), F.lit(1).alias("rank"), "_batch_pos")
    source = rows.select("_pos", F.lit("source_file").alias("field"), F.col("new.source_file").alias("value"), F.lit(2).alias("rank"), "_batch_pos").where("value is not null")
    every = single.unionByName(group).unionByName(silent).unionByName(source)
    best = every.groupBy("_pos", "field").agg(F.max_by("value", F.struct("rank", "_batch_pos")).alias("value"))
    if decisions is not None:
        d = decisions.select("_pos", "field", F.col("value").alias("_value"), "approved")
        best = best.join(d, ["_pos", "field"], "full").where("coalesce(approved, true)").select("_pos", "field", F.coalesce("_value", "value").alias("value"))
    return best


def default_inserts(plan: MergePlan) -> DataFrame:
    """New rows: duplicates merged into one, with agreed or default values and all their source files, and ids made."""
    grouped = plan.unmatched.join(plan.duplicates, "_pos", "left")
    alone = grouped.where("component is null").drop("component")
    several = grouped.where("component is not null")
    choice = field_choices(several, "component", COLUMNS, "_pos", blanks_count=True)
    merged = choice.groupBy("component").pivot("field", COLUMNS).agg(F.first(F.coalesce("value", "default")))
    files = several.groupBy("component").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "source_file"))), lambda x: x["source_file"])), " + ").alias("_files"))
    merged = merged.join(files, "component").withColumn("source_file", F.col("_files"))
    merged = merged.select(*[F.col(c).cast(LISTING[c].dataType).alias(c) for c in COLUMNS], F.col("component").alias("_pos"))
    return backfill_ids(alone.unionByName(merged))


def apply_merge(master: DataFrame, updates: DataFrame, inserts: DataFrame, removed: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """The new master: removed rows go whatever their updates, approved fields overlay, new rows follow.

    updates: (_pos, field, value); inserts: listing columns and _pos; removed: (_pos). Positions of new
    rows start after the master's, by their order in the batch. A null value clears a field; a value
    that is no number leaves a number as it was. top: the last position, where master is a part only.
    """
    kept = master.join(removed.select("_pos").distinct(), "_pos", "left_anti") if removed is not None else master
    over = updates.where(F.col("field").isin(COLUMNS)).groupBy("_pos").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_u"))
    def merged(c):
        value = F.col("_u")[c].try_cast(LISTING[c].dataType)
        told = F.map_contains_key("_u", F.lit(c)) & (value.isNotNull() | F.col("_u")[c].isNull())
        return F.when(told, value).otherwise(F.col(c)).alias(c)

    cols = [merged(c) for c in COLUMNS]
    out = kept.join(over, "_pos", "left").select("_pos", *cols)
    last = master.agg(F.coalesce(F.max("_pos"), F.lit(-1)).alias("_top"))
    new = inserts.crossJoin(F.broadcast(last)) if top is None else inserts.withColumn("_top", F.lit(top).cast("long"))
    new = new.select((F.col("_top") + 1 + F.col("_pos")).alias("_pos"), *COLUMNS)
    return out.unionByName(new)


def manual_edit(master: DataFrame, edits: DataFrame, displayed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new master, changes) of edits (pos, field, value); unknown fields are ignored.

    displayed (pos, _pos) maps positions on a filtered view to the master's.
    """
    known = edits.where(F.col("field").isin(COLUMNS))
    known = known.join(displayed, "pos").drop("pos") if displayed is not None else known.withColumnRenamed("pos", "_pos")
    return apply_merge(master, known, master.limit(0)), approval_summary(master, known)


def approval_summary(master: DataFrame, updates: DataFrame) -> DataFrame:
    """(property, field, old, new) of every update but those of source_file."""
    entries = F.map_from_arrays(F.array(*map(F.lit, COLUMNS)), F.array(*[F.col(c).cast("string") for c in COLUMNS]))
    old = master.select("_pos", row_label(F.col("building"), F.col("provider"), F.col("floor_unit")).alias("property"), entries.alias("_old"))
    rows = updates.where("field <> 'source_file'").join(old, "_pos")
    return rows.select("property", "field", F.col("_old")[F.col("field")].alias("old"), F.col("value").alias("new"))


def select_properties(before: DataFrame, visible: DataFrame, chosen: DataFrame) -> DataFrame:
    """A selection of property_id after an edit of what is visible: the rest of the old one and the new choice."""
    return before.join(visible, "property_id", "left_anti").union(chosen).distinct()


def near_misses(plan: MergePlan) -> DataFrame:
    """New digit-free rows that have a suggestion, with it."""
    return plan.unmatched.where(digit_free(F.col("building"))).join(plan.suggestions, "building")


def status_line(plan: MergePlan, uploads: int) -> str:
    """What is pending, in words; zero counts are left out."""
    n = plan.matched.agg(F.count_if("changed").alias("changed"), F.count("*").alias("all")).first()
    new = plan.unmatched.count()
    parts = [f"{new} new propert{'y' if new == 1 else 'ies'}"] * bool(new)
    parts += [f"{n['changed']} propert{'y' if n['changed'] == 1 else 'ies'} with changes"] * bool(n["changed"])
    head = f"{uploads} upload{'' if uploads == 1 else 's'} pending"
    return f"{head} — {', '.join(parts)}" if parts else f"{head} — no changes" if n["all"] else head

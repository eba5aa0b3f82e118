"""Matching a batch of listings to the master: exact tiers, then blocked fuzzy names. Several candidates are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import is_blank
from ..functions.similarity import block_pairs, scored_pairs, segment_candidates
from ..functions.text import digit_free, name_part, normalize_key, postcode_key

FUZZY_CUTOFF = 0.85
KEYS = ["k_building", "k_provider", "k_floor"]


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with the match keys; k_postcode is null without a postcode, k_name without a digit-free building."""
    building = F.col("building")
    return rows.withColumns(
        {
            "k_building": normalize_key(building),
            "k_provider": normalize_key(F.col("provider")),
            "k_floor": normalize_key(F.col("floor_unit")),
            "k_postcode": F.when(~is_blank(F.col("postcode")), postcode_key(F.col("postcode"))),
            "k_name": F.when(digit_free(building), normalize_key(name_part(building))),
        }
    )


def match_positions(batch: DataFrame, master: DataFrame, fuzzy: bool = True, pos: str = "_pos", checkpoint=None, columns: list[str] | None = None) -> DataFrame:
    """batch with match_tier (postcode, fallback, fuzzy_building or null) and master_pos, the position of the row it matched.

    A tier matches when exactly one master row has the key. The postcode tier needs a postcode; the
    fallback ignores it, even a conflicting one; the fuzzy tier looks at rows still unmatched whose
    building has no digit. The master's keys are counted once, in one aggregate that all tiers read.
    Only keys that are unique on the master's side are joined, so no batch row is multiplied, and fuzzy
    names are scored once for each distinct pair within a block, whose pairs are dealt evenly whatever its size. `pos` is distinct in the master.
    checkpoint(df, name) keeps the master's keys, what the exact tiers found and the pairs of names, which are read more than once.
    columns: those of batch, and its match keys, that the result has, by default all of batch; no others are kept.
    """
    columns = batch.columns if columns is None else columns
    keep = checkpoint or (lambda df, name: df)
    new = with_keys(batch)
    names = ["k_name"] if fuzzy else []
    kinds = with_keys(master).groupBy(*KEYS, "k_postcode", *names).agg(F.count("*").alias("_n"), F.min(pos).alias("_at"))
    kinds = keep(kinds, "kinds") if fuzzy else kinds
    count = lambda rows, keys, at: rows.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_at").alias(at))
    sole = lambda rows, keys, at: count(rows, keys, at).where("_n = 1").drop("_n")
    coded = kinds.where("k_postcode is not null")
    first = sole(coded, [*KEYS, "k_postcode"], "_m1") if fuzzy else coded.where("_n = 1").select(*KEYS, "k_postcode", F.col("_at").alias("_m1"))
    out = new.join(first, [*KEYS, "k_postcode"], "left").join(sole(kinds, KEYS, "_m2"), KEYS, "left")
    tier = F.when(F.col("_m1").isNotNull(), "postcode").when(F.col("_m2").isNotNull(), "fallback")
    found = F.coalesce("_m1", "_m2")
    if fuzzy:
        block = ["k_provider", "k_floor"]
        out = keep(out.select(*dict.fromkeys([*columns, *block, "k_name", "_m1", "_m2"])), "exact")
        heads = count(kinds.where("k_name is not null").withColumnRenamed("k_name", "_old"), [*block, "_old"], "_at")
        asks = out.where(tier.isNull() & F.col("k_name").isNotNull()).select(*block, F.col("k_name").alias("_new")).distinct()
        pairs = keep(block_pairs(asks, heads, block, "_new", "_old", FUZZY_CUTOFF), "pairs")
        near = scored_pairs(pairs, "_new", "_old", FUZZY_CUTOFF)
        close = pairs.join(near, ["_new", "_old"]).groupBy(*block, F.col("_new").alias("k_name")).agg(F.sum("_n").alias("_n"), F.min("_at").alias("_m3"))
        out = out.join(close.where("_n = 1").drop("_n"), [*block, "k_name"], "left")
        third = F.when(tier.isNull(), F.col("_m3"))
        tier = F.coalesce(tier, F.when(third.isNotNull(), F.lit("fuzzy_building")))
        found = F.coalesce(found, third)
    return out.select(*columns, tier.alias("match_tier"), found.alias("master_pos"))


def match_batch(batch: DataFrame, master: DataFrame, fuzzy: bool = True, pos: str = "_pos", checkpoint=None) -> DataFrame:
    """batch with match_tier and `master`, the whole row that match_positions found."""
    rows = master.select(F.col(pos).alias("master_pos"), F.struct(*master.columns).alias("master"))
    found = match_positions(batch, master, fuzzy, pos, checkpoint)
    return found.join(rows, "master_pos", "left").select(*batch.columns, "match_tier", "master")


def suggest_similar(rows: DataFrame, master: DataFrame, top: int = 3) -> DataFrame:
    """(building, suggestion, ratio): master buildings like the digit-free buildings of rows, at most `top` each.

    Names are compared by building alone, with every distinct key of the master. Candidates share a
    segment where few edits can have left it; ties go by key.
    """
    new = rows.where(digit_free(F.col("building"))).select("building", normalize_key(F.col("building")).alias("_new")).where("_new <> ''").distinct()
    old = master.select(normalize_key(F.col("building")).alias("_old"), "building").where("_old <> ''").groupBy("_old").agg(F.min("building").alias("suggestion"))
    near = scored_pairs(segment_candidates(new, "_new", old, "_old", FUZZY_CUTOFF), "_old", "_new", FUZZY_CUTOFF)
    place = F.row_number().over(Window.partitionBy("_new").orderBy(F.desc("ratio"), "_old"))
    best = near.withColumn("_place", place).where(F.col("_place") <= top)
    return new.join(best, "_new").join(old, "_old").select("building", "suggestion", "ratio")

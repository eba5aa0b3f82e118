"""Master rows that a provider's complete upload no longer shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SNAPSHOT_PROVIDERS, clean_provider, normalize_key


def stale_candidates(batch: DataFrame, master: DataFrame, matched: DataFrame, pos: str = "_pos", fully_occupied: DataFrame | None = None, snapshot: list[str] | DataFrame = SNAPSHOT_PROVIDERS) -> DataFrame:
    """master rows of providers that always send everything, unmatched, with evidence that they have gone.

    Evidence is a building that the upload calls fully occupied, or a building that it mentions
    without this unit. matched has the positions of matched master rows. snapshot names those
    providers, in their clean form: a short list, or a table (provider) of any size.
    """
    if isinstance(snapshot, DataFrame):
        names = snapshot.select(clean_provider(F.col("provider")).alias("_p")).distinct()
        full = lambda df: df.join(names, "_p", "left_semi")
    else:
        full = lambda df: df.where(F.col("_p").isin(snapshot))
    keyed = lambda df: df.withColumns({"_p": clean_provider(F.col("provider")), "_b": normalize_key(F.col("building"))})
    old = full(keyed(master)).join(matched.select(pos).distinct(), pos, "left_anti").withColumn("_u", normalize_key(F.col("floor_unit")))
    new = full(keyed(batch)).select("_p", "_b", normalize_key(F.col("floor_unit")).alias("_u")).distinct()
    gone = old.join(new.select("_p", "_b").distinct(), ["_p", "_b"], "left_semi").join(new, ["_p", "_b", "_u"], "left_anti")
    if fully_occupied is not None:
        let = keyed(fully_occupied.where("building is not null and trim(building) <> ''")).select("_p", "_b").distinct()
        gone = gone.join(let, ["_p", "_b"], "left_anti").unionByName(old.join(let, ["_p", "_b"], "left_semi"))
    return gone.select(*master.columns)

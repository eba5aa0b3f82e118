"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id reachable.

    Each round lets every node tell its larger neighbours, then its smaller ones, of the smallest
    neighbour it knows. Both steps are one aggregate and one equi-join on edges, so a star with
    very many leaves is split by Spark like any skewed join. Ids alone, null edges and self
    loops yield a component of one; an empty table yields an empty result.
    """
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first = scratch.save(e, "edges")
    cur, saved, state = first.where("u > v"), None, None
    for _ in range(rounds):
        # large star: u's larger neighbours are told of u's smallest neighbour (or of u itself)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u's smaller neighbours, and u, are told of the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        new = scratch.save(small, "stars")
        if saved is not None:
            scratch.drop(saved)
        saved = new
        now = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum("v")).first()
        if now == state:
            cur = new
            break
        state, cur = now, new
    else:
        raise RuntimeError("components did not settle")
    nodes = first.select(F.col("u").alias("id")).union(first.select(F.col("v").alias("id"))).distinct()
    roots = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    out = scratch.save(nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component")), "components")
    scratch.drop(first, saved)
    return out

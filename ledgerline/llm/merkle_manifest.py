"""A Merkle manifest of a table: one tree for each group of rows, one tree over the groups' roots, a proof for each row.

Nodes of a group are numbered in order, cut into blocks of RUN ** LEVELS, and each block is an ordered array
that sequence, transform, slice and aggregate collapse level by level inside one expression. The roots of the
blocks are the nodes of the next round. Proofs come down the same way: a block hands each child the
siblings inside the block followed by those above it. No step holds more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts

#: Nodes that are hashed together, and levels of the tree that one block holds.
RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*map(framed, values)))


def _height(n: Column) -> Column:
    """Levels above n nodes: none above one, else the octal digits of n - 1 (RUN is 8)."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, RUN))).otherwise(0)


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """nodes (grp, ...) with `at`, the place in its group by order, and `height`, the levels above the group's nodes.

    A range shuffle deals the rows in order, equal ones too; places come from each partition's first row and the counts
    before it, so no task sees a group.
    """
    order = ["grp", *order, "_tie"]
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(scratch.spark), *order).sortWithinPartitions(*order).drop("_tie")
    dealt = scratch.save(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "dealt")
    group = Window.partitionBy("grp")
    parts = dealt.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "part", _height(F.sum("rows").over(group)).alias("height"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(parts, ["grp", "part"]).withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _collapse(nodes: Column) -> Column:
    """The level above an ordered array of nodes: the digest of every RUN of them, the last run as it is."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / RUN).cast("int") - 1)
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(nodes, k * RUN + 1, RUN), "")))


def _blocks(nodes: DataFrame, carry: list[str], scratch: Scratch) -> DataFrame:
    """Blocks (grp, block, height, items, trail): trail holds the block's levels, its nodes first and its root last."""
    rows = nodes.groupBy("grp", F.expr(f"at div {BLOCK}").alias("block"), "height").agg(F.sort_array(F.collect_list(F.struct("at", "node", *carry))).alias("items"))
    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, F.least("height", F.lit(LEVELS)))
    start = F.array(F.transform("items", lambda x: x["node"]))
    trail = F.aggregate(steps, start, lambda levels, _: F.concat(levels, F.array(_collapse(F.element_at(levels, -1)))))
    return scratch.save(rows.withColumn("trail", trail), "blocks")


def _steps(at: Column) -> Column:
    """The siblings of a block's node, level by level: digests before it in its run, and after it."""

    def step(level: Column) -> Column:
        row = F.element_at("trail", level + 1)
        k = F.floor(at / F.pow(F.lit(RUN), level)).cast("int")
        place = k % RUN
        before, after = F.slice(row, k - place + 1, place), F.slice(row, k + 2, RUN - 1 - place)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    levels = F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), 1, F.size("trail") - 1)
    return F.transform(levels, step)


def _climb(nodes: DataFrame, carry: list[str], scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks, leaves first, and (grp, node): the root of each group."""
    rounds, carried = [], carry
    while True:
        blocks = _blocks(nodes, carried, scratch)
        rounds.append(blocks)
        top = F.element_at(F.element_at("trail", -1), 1)
        nodes, carried = blocks.select("grp", F.greatest(F.col("height") - LEVELS, F.lit(0)).alias("height"), F.col("block").alias("at"), top.alias("node")), []
        if blocks.where(F.col("height") > LEVELS).isEmpty():
            return rounds, nodes.select("grp", "node")


def _descend(rounds: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The blocks of the first round with `path`, what stands beside and above their roots; tops: (grp, path, keep)."""
    above = tops.withColumn("at", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        child = F.transform("items", lambda x, i: F.struct(x["at"].alias("at"), F.concat(_steps(i), F.col("path")).alias("path")))
        above = blocks.join(above.withColumnRenamed("at", "block"), ["grp", "block"]).select("grp", *keep, F.explode(child).alias("c")).select("grp", *keep, "c.at", "c.path")
    return rounds[0].join(above.withColumnRenamed("at", "block"), ["grp", "block"])


@dataclass
class Manifest:
    """rows: (order, leaf, claim, subroot, root, path) of each row; path is its siblings from the leaf to the root."""

    rows: DataFrame

    def proofs(self) -> DataFrame:
        """Rows with proof_sha256, the digest of all siblings, folded_root, made anew from claim, and verified."""
        siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
        folded = F.aggregate("path", F.col("claim"), lambda node, p: digest(F.concat(p["before"], node, p["after"])))
        out = self.rows.select("id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def build_manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None) -> Manifest:
    """The manifest of docs: leaves are digests of `fields`, trees are made for each `group` in ascending `order`.

    claim: a leaf digest to be checked against the manifest, the row's own unless it is given. Nulls of any field, empty
    and long texts are framed each in their way, so all differ; null groups and null orders are a group and an order of their own, first
    of all; rows of one order stand by leaf, and equal rows beside each other, each with its own
    proof; columns beside the fields are ignored, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    leaf = leaf_digest([docs[f"`{c}`"] for c in fields])
    key = docs[f"`{group}`"].cast("string")
    leaves = scratch.save(docs.select(framed(key).alias("grp"), key.alias("name"), docs[f"`{order}`"].alias("id"), leaf.alias("node"), (leaf if claim is None else claim).alias("claim")), "leaves")
    numbered = _numbered(leaves.drop("name"), ["id", "node"], scratch)
    rounds, roots = _climb(numbered, ["id", "claim"], scratch)
    names = leaves.groupBy("grp").agg(F.first("name", ignorenulls=True).alias("name"))
    groups = scratch.save(roots.join(names, "grp").select(F.lit("").alias("grp"), "name", "node", F.col("grp").alias("tree")), "groups")
    over, top = _climb(_numbered(groups, ["name"], scratch), ["tree"], scratch)
    whole = _descend(over, top.select("grp", F.lit(None).cast(PATH).alias("path"), F.col("node").alias("root")).withColumn("path", F.coalesce("path", F.array().cast(PATH))), ["root"])
    subroots = F.transform("items", lambda x, i: F.struct(x["tree"].alias("grp"), x["node"].alias("subroot"), F.concat(_steps(i), F.col("path")).alias("path")))
    tops = scratch.save(whole.select("root", F.explode(subroots).alias("c")).select("c.*", "root"), "tops")
    blocks = _descend(rounds, tops, ["subroot", "root"])
    rows = F.transform("items", lambda x, i: F.struct(x["id"].alias("id"), x["node"].alias("leaf"), x["claim"].alias("claim"), F.concat(_steps(i), F.col("path")).alias("path")))
    return Manifest(blocks.select("subroot", "root", F.explode(rows).alias("c")).select("c.*", "subroot", "root"))

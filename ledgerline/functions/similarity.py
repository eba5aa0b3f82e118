"""Ratcliff-Obershelp similarity, for which Spark has no function: scored once for each distinct pair."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Pairs whose common characters are counted at once, and the longest text that one machine word stands for.
STEP, WORD = 4096, 64


def common_chars(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair, by one word of bits for each; texts up to WORD characters."""
    points = lambda t: np.array([list(map(ord, x.ljust(max(map(len, t)), "\0"))) for x in t]).reshape(len(t), -1)
    x, y = points(a), points(b)
    own = np.arange(x.shape[1]) < np.array(list(map(len, a)))[:, None]
    bits = np.where(own, np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64), np.uint64(0))
    size = np.array(list(map(len, b)))
    state = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(y.shape[1]):
        hits = np.where((x == y[:, k, None]) & (k < size)[:, None], bits, np.uint64(0)).sum(1, dtype=np.uint64)
        used = state & hits
        state = (state + used) | (state - used)
    return np.bitwise_count(~state & bits.sum(1, dtype=np.uint64)).astype(int)


def _may_match(a: pd.Series, b: pd.Series, cutoff: float) -> np.ndarray:
    """Whether the characters in common, in order, allow the ratio; a long text may always."""
    total = (a.str.len() + b.str.len()).to_numpy()
    out = np.ones(len(a), bool)
    short = np.flatnonzero((a.str.len().to_numpy() <= WORD) & (b.str.len().to_numpy() <= WORD) & (total > 0))
    for i in range(0, len(short), STEP):
        some = short[i : i + STEP]
        out[some] = 2 * common_chars(a.iloc[some].tolist(), b.iloc[some].tolist()) >= cutoff * total[some] - 1e-9
    return out


def _ratio(cutoff: float):
    """The ratio of two texts, null where it cannot be cutoff."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, last, out = difflib.SequenceMatcher(), None, []
        for x, y, near in zip(a, b, _may_match(a, b, cutoff), strict=True):
            if not near:
                out.append(None)
                continue
            if y != last:  # the second text is indexed, so equal neighbours share the index
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype=float)

    return ratio


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """A bound from lengths alone that every pair with that ratio meets."""
    x, y = F.length(a), F.length(b)
    return 2 * F.least(x, y) >= cutoff * (x + y)


def scored_pairs(pairs: DataFrame, a: str, b: str, cutoff: float, out: str = "ratio") -> DataFrame:
    """Distinct (a, b) of pairs whose ratio is at least cutoff.

    Before any is scored, pairs whose lengths are too far apart go, then those with too few characters in common: a
    ratio counts characters in common, in order, so it is at most what a longest common subsequence gives.
    """
    distinct = pairs.where(may_reach(F.col(a), F.col(b), cutoff)).select(a, b).distinct()
    return distinct.withColumn(out, _ratio(cutoff)(a, b)).where(F.col(out) >= cutoff)


#: Characters of which a mask tells whether a text has one, and whether it has two.
_ONE, _TWO = "abcdefghijklmnopqrstuvwxyz0123456789 ", "abcdefghijklmnopqrstuvwxy"


def char_mask(c: Column) -> Column:
    """62 bits: which of _ONE a text has, and which of _TWO twice. Two masks differ in no more bits than
    characters must be put in or taken out to make one text of the other.
    """
    first, last = lambda x: F.instr(c, F.lit(x)), lambda x: F.length(c) + 1 - F.instr(F.reverse(c), F.lit(x))
    tests = [first(x) > 0 for x in _ONE] + [(first(x) > 0) & (first(x) < last(x)) for x in _TWO]
    out = F.lit(0).cast("long")
    for k, t in enumerate(tests):
        out = out.bitwiseOR(F.when(t, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _measured(t: DataFrame, c: str, side: str) -> DataFrame:
    """t with the length and the mask of the text c, which pairs are compared by."""
    return t.withColumns({f"_len_{side}": F.length(c), f"_mask_{side}": char_mask(F.col(c))})


def _may_be_near(cutoff: float) -> Column:
    """Bounds from lengths and masks that every pair with that ratio meets."""
    x, y = F.col("_len_a"), F.col("_len_b")
    edits = F.floor((x + y) * (1 - cutoff) + 1e-9)
    return (F.abs(x - y) <= edits) & (F.bit_count(F.col("_mask_a").bitwiseXOR(F.col("_mask_b"))) <= edits)


def block_tiles(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Two tables of names under the same blocks, dealt into tiles (tile_a, tile_b) of about `tile` names a side.

    A block of m and n names is m / tile by n / tile tiles, so that all pairs of a block of any size are spread over
    tasks in pieces of one size; a name goes to a row or a column of them.
    """
    count = lambda t, out: t.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias(out))
    sizes = count(left, "_x").join(count(right, "_y"), block)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = left.join(sizes, block).withColumn("tile_a", part(a, "_x")).withColumn("tile_b", every("_y")).drop("_x", "_y")
    y = right.join(sizes, block).withColumn("tile_b", part(b, "_y")).withColumn("tile_a", every("_x")).drop("_x", "_y")
    return x, y


def block_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, cutoff: float, tile: int = 1024) -> DataFrame:
    """Pairs (block, a, b, other columns of right) inside blocks whose ratio may reach cutoff."""
    x, y = block_tiles(_measured(left, a, "a"), _measured(right, b, "b"), block, a, b, tile)
    pairs = x.join(y, [*block, "tile_a", "tile_b"]).where(_may_be_near(cutoff))
    return pairs.drop("tile_a", "tile_b", "_len_a", "_len_b", "_mask_a", "_mask_b")


def _lengths(n: Column, cutoff: float) -> Column:
    """Lengths of texts that a text of length n can have the ratio with."""
    low, high = F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9), F.floor(n * ((2 - cutoff) / cutoff) + 1e-9)
    return F.sequence(low.cast("int"), high.cast("int"))


def _edits(x: Column, y: Column, cutoff: float) -> Column:
    """The most characters put in or taken out between texts of two lengths with the ratio."""
    most = F.floor((x + y) * (1 - cutoff) + 1e-9).cast("int")
    return most - F.pmod(most - F.abs(x - y), F.lit(2))


def _segment(n: Column, edits: Column, k: Column) -> tuple[Column, Column]:
    """(start, length) of the k-th of edits + 1 nearly equal segments of a text of length n."""
    parts = edits + 1
    base = F.floor(n / parts).cast("int")
    short = parts - n % parts  # segments of the base length come first
    return k * base + F.greatest(F.lit(0), k - short), base + (k >= short).cast("int")


def _own_segments(c: Column, cutoff: float) -> Column:
    """Keys (length, edits, k, text) of a text's segments, for every number of edits that it may be asked with."""
    n = F.length(c)

    def cut(edits):
        def one(k):
            start, size = _segment(n, edits, k)
            return F.struct(n.alias("n"), edits.alias("edits"), k.alias("k"), F.substring(c, start + 1, size).alias("text"))

        return F.transform(F.sequence(F.lit(0), edits), one)

    return F.flatten(F.transform(F.array_distinct(F.transform(_lengths(n, cutoff), lambda m: _edits(n, m, cutoff))), cut))


def _asked_segments(c: Column, cutoff: float) -> Column:
    """Keys of the segments that a near text may have, each where at most the edits before and behind it move it."""
    m = F.length(c)

    def of_length(n):
        edits, longer = _edits(n, m, cutoff), m - n

        def one(k):
            start, size = _segment(n, edits, k)
            low = F.greatest(-k, longer - (edits - k), F.floor((longer - edits) / 2).cast("int"), -start)
            high = F.least(k, longer + (edits - k), F.floor((longer + edits) / 2).cast("int"), m - size - start)
            moves = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            return F.transform(moves, lambda d: F.struct(n.alias("n"), edits.alias("edits"), k.alias("k"), F.substring(c, start + d + 1, size).alias("text")))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), one))

    return F.array_distinct(F.flatten(F.transform(_lengths(m, cutoff), of_length)))


def segment_candidates(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float) -> DataFrame:
    """Distinct (a, b) of two tables' nonempty texts that share a segment and may reach cutoff: all near pairs, and few others.

    A ratio bounds the characters put in and taken out between two texts. If b is cut into one segment more
    than that, one of them is in a unchanged, moved by no more than the edits on either side of it.
    """

    def keyed(t, c, side, segments):
        texts = _measured(t.select(c).where(F.length(c) > 0).distinct(), c, side)
        return texts.withColumn("t", F.explode(segments(F.col(c), cutoff))).select(c, f"_len_{side}", f"_mask_{side}", "t.*")

    x, y = keyed(left, a, "a", _asked_segments), keyed(right, b, "b", _own_segments)
    return x.join(y, ["n", "edits", "k", "text"]).where(_may_be_near(cutoff)).select(a, b).distinct()

"""Candidates of near names: every pair with the ratio is among them, few others are, and no task has most of them."""

import difflib
import itertools
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.similarity import block_pairs, block_tiles, char_mask, common_chars, scored_pairs, segment_candidates

NAMES = "heron larch quince plover cedar alder rowan maple house court lofts yard mill place works".split()


def made(seed, n, letters="abcdefgh "):
    r, out = random.Random(seed), set()
    while len(out) < n:
        name = " ".join(r.sample(NAMES, r.choice([1, 2, 3]))) if r.random() < 0.7 else "".join(r.choices(letters, k=r.randrange(1, 14))).strip()
        chars = list(name)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(chars) + 1)
            chars[k : k + r.randrange(2)] = r.choice(["", "x", "é", "\U0001f600", "a"])
        if chars:
            out.add("".join(chars))
    return sorted(out)


def table(spark, names, column):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def ratio(x, y):
    return difflib.SequenceMatcher(None, x, y).ratio()


@pytest.mark.parametrize("cutoff", [0.85, 0.7, 1.0])
def test_segments_lose_nothing(spark, cutoff):
    new, old = made(1, 250), made(2, 400) + made(1, 250)[:40]
    got = {tuple(r) for r in segment_candidates(table(spark, [*new, ""], "a"), "a", table(spark, [*old, ""], "b"), "b", cutoff).collect()}
    near = {(x, y) for x, y in itertools.product(new, old) if ratio(x, y) >= cutoff}
    assert near <= got and len(near) >= 40


def test_short_and_equal_names(spark):
    words = ["".join(w) for k in (1, 2, 3, 4, 5) for w in itertools.product("ab", repeat=k)]
    got = {tuple(r) for r in segment_candidates(table(spark, words, "a"), "a", table(spark, words, "b"), "b", 0.75).collect()}
    assert {(x, y) for x, y in itertools.product(words, words) if ratio(x, y) >= 0.75} <= got


def test_few_candidates(spark):
    r = random.Random(5)
    old = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(8, 30))) for _ in range(3000)]
    new = [o[:k] + o[k + 1 :] for o in old[:300] for k in (r.randrange(len(o)),)]
    got = segment_candidates(table(spark, new, "a"), "a", table(spark, old, "b"), "b", 0.85).collect()
    assert {(n, o) for n, o in zip(new, old, strict=False)} <= {tuple(r) for r in got} and len(got) < 0.001 * len(new) * len(old)


def test_masks_and_words_bound_edits(spark):
    names = made(3, 120)
    masks = dict(table(spark, names, "a").select("a", char_mask(F.col("a"))).collect())
    pairs = list(itertools.product(names, names))
    common = common_chars([x for x, _ in pairs], [y for _, y in pairs])
    assert common_chars(["", "a" * 64, "\0b"], ["a", "a" * 64, "b"]).tolist() == [0, 64, 1]
    for (x, y), have in zip(pairs, common, strict=True):
        lcs = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x[i] == y[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert have == lcs[-1][-1]
        assert (masks[x] ^ masks[y]).bit_count() <= len(x) + len(y) - 2 * lcs[-1][-1]


@pytest.mark.parametrize("tile", [1024, 7])
def test_blocks_against_a_loop(spark, tile):
    rows = [(k % 3, n) for k, n in enumerate(made(6, 150))]
    old = [(k % 4, n, k) for k, n in enumerate(made(7, 200) + made(6, 40))]
    x, y = spark.createDataFrame(rows, "p int, a string"), spark.createDataFrame(old, "p int, b string, at int")
    pairs = block_pairs(x, y, ["p"], "a", "b", 0.85, tile)
    near = scored_pairs(pairs, "a", "b", 0.85)
    got = sorted(tuple(r) for r in pairs.join(near, ["a", "b"]).select("p", "a", "b", "at").collect())
    assert got == sorted((p, a, b, at) for (p, a), (q, b, at) in itertools.product(rows, old) if p == q and ratio(a, b) >= 0.85)


def test_one_large_block_is_dealt_evenly(spark):
    """20,000 names on one side of one block, and many small blocks."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=18))
    big = [word() for _ in range(20_000)]
    old = [(0, n) for n in big] + [(k, word()) for k in range(1, 200) for _ in range(20)]
    new = [(0, n[:9] + n[10:]) for n in big[:5000]] + [(k, word()) for k in range(1, 200) for _ in range(20)]
    x, y = spark.createDataFrame(new, "p int, a string"), spark.createDataFrame(old, "p int, b string")
    key = ["p", "tile_a", "tile_b"]
    a, b = (t.groupBy(*key).agg(F.count("*").alias(n)) for t, n in zip(block_tiles(x, y, ["p"], "a", "b"), "mn", strict=True))
    tasks = a.join(b, key).repartition(8, *key).groupBy(F.spark_partition_id()).agg(F.sum(F.col("m") * F.col("n")).alias("pairs")).collect()
    work = [t.pairs for t in tasks]
    assert sum(work) == 5000 * 20_000 + 199 * 400 and max(work) <= 2 * statistics.median(work)
    start = time.time()
    pairs = block_pairs(x, y, ["p"], "a", "b", 0.85)
    got = scored_pairs(pairs, "a", "b", 0.85).count()
    assert got >= 5000 and time.time() - start < 60

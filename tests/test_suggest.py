"""Suggestions of near names against a plain loop of SequenceMatcher."""

import difflib

from ledgerline.operators.match import suggest_similar
from ledgerline.queries import QUERIES
from ledgerline.queries.adapter import sides

DATA = "/root/testdata/sf0.001"


def loop(new, old, top=3):
    """Names as they are, for keys equal to the names; ties go by key."""
    out = set()
    for n in {x for x in new if x and not any(c.isdigit() for c in x)}:
        scored = sorted((-q, o) for o in {x for x in old if x} if (q := difflib.SequenceMatcher(None, o, n).ratio()) >= 0.85)
        out |= {(n, o, -q) for q, o in scored[:top]}
    return out


def test_suggestions(spark):
    new = ["kingsgate", "blue bolt", "bridge house", "the old mill yard", "aa", "\U00020000 loft", "tide", "blue bolt 4", "", None]
    old = ["ringsgate", "kingsgate 7", "blue bolt 3", "blue bolt", "blue bolt 12", "lue bolt", "fridge mouse", "bridge hause", "7bridge house", "teh old mill yard", "het oldmill yard", "aaa", "baa", "\U00020000 lofts", "diet", "", None]
    tables = [spark.createDataFrame([(x,) for x in t], "building string") for t in (new, old)]
    got = {tuple(r) for r in suggest_similar(*tables).collect()}
    assert got == loop(new, old) and {("kingsgate", "ringsgate"), ("blue bolt", "blue bolt 3")} <= {r[:2] for r in got}


def test_query_searches_whole_master(spark):
    batch, master = ([r.building for r in t.select("building").distinct().collect()] for t in sides(spark, DATA))
    got = {tuple(r) for r in QUERIES["suggest_near"](spark, DATA).collect()}
    assert got == loop(batch, master) and any(any(c.isdigit() for c in r[1]) for r in got)

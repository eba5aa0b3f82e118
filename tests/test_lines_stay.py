"""Lines exploded from a small file are no small table, and meet names once."""

import pytest

from ledgerline.operators import sheets
from ledgerline.queries import QUERIES


def sent_whole(plan):
    """What an executed plan sends to all executors after exploding it, without a shuffle that tells its size."""
    rows = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.split("== Initial Plan ==")[0].splitlines()]
    out = []
    for k, (depth, row) in enumerate(rows):
        if "BroadcastExchange" in row:
            known = None
            for d, x in rows[k + 1 :]:
                if d <= depth:
                    break
                if known is not None and d > known:
                    continue
                known = d if "Exchange hashpartitioning" in x else None
                if "Generate" in x:
                    out.append(x)
    return out


@pytest.mark.parametrize("name", ["house_numbers", "block_links", "sheet_warnings"])
def test_exploded_lines_are_not_sent_to_all(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "== Final Plan ==" in plan and not sent_whole(plan)


def test_a_line_is_asked_for_the_sizes_of_its_sheets_names(spark):
    lines = spark.createDataFrame([("f", s, k, t) for s in "abc" for k, t in enumerate(["larch house", "lar", "l", ""])], "file string, sheet string, row_no int, t string")
    names = spark.createDataFrame([("f", "a", "larch"), ("f", "a", "larch house"), ("f", "b", "l"), ("f", "b", ""), ("f", "b", None)], "file string, sheet string, name string")
    asked = sheets._asked(lines, names, "name", 4)
    assert {(r.sheet, *sorted(r._sizes)) for r in asked.collect()} == {("a", 4), ("b", 0, 1)}
    met = sheets._beginning(lines, "t", names, "name").select("sheet", "row_no", "name").collect()
    assert sorted(met) == sorted([("a", 0, "larch"), ("a", 0, "larch house"), *[("b", k, "l") for k in range(3)], *[("b", k, "") for k in range(4)]])
    held = sheets._containing(lines, "t", names.where("name <> ''"), "name").select("sheet", "row_no", "name").collect()
    assert sorted(held) == sorted([("a", 0, "larch"), ("a", 0, "larch house"), *[("b", k, "l") for k in range(3)]])

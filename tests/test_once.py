"""Queries that match fold the order lines once, and carry only the columns they need."""

import pyarrow as pa

from ledgerline.operators.links import PAGES, anchor_rows
from ledgerline.operators.match import match_positions
from ledgerline.operators.resolve import duplicate_keys
from ledgerline.queries.linkage import QUERIES

SF = "/root/testdata/sf0.001"


def test_plan_of_a_merge_reads_lines_once(spark):
    for name in ("apply_plan", "change_split", "match_tiers"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "lineitem" not in plan and "l_orderkey" not in plan


def test_columns_that_a_match_keeps(spark):
    of = "building string, provider string, floor_unit string, postcode string, note string"
    master = spark.createDataFrame([(1, "Elm House", "P", "1", None, "x"), (2, "Oak House", "P", "1", "N1 1AA", "x")], f"_pos long, {of}")
    batch = spark.createDataFrame([(1, "elm houses", "p", "1", None, "y"), (2, "Oak House", "P", "1", "n11aa", "y"), (3, "Yew", "P", "1", None, "y")], f"_batch_pos long, {of}")
    wide = {}

    def keep(df, name):
        wide[name] = df.columns
        return df

    few = match_positions(batch, master, checkpoint=keep, columns=["_batch_pos", "building", "k_floor"])
    assert few.columns == ["_batch_pos", "building", "k_floor", "match_tier", "master_pos"] and not {"note", "k_building", "postcode"} & {*wide["exact"]}
    assert sorted(few.drop("k_floor").collect()) == [(1, "elm houses", "fuzzy_building", 1), (2, "Oak House", "postcode", 2), (3, "Yew", None, None)]
    assert sorted(few.drop("k_floor").collect()) == sorted(match_positions(batch, master).select("_batch_pos", "building", "match_tier", "master_pos").collect())
    keyed = match_positions(batch, master, False, columns=["_batch_pos", "building", "k_building", "k_provider", "k_floor", "k_postcode"]).withColumnRenamed("_batch_pos", "_pos")
    assert sorted(duplicate_keys(keyed).collect()) == sorted(duplicate_keys(batch.withColumnRenamed("_batch_pos", "_pos")).collect())


def test_anchors_of_few_pages_at_a_time():
    html = [f"<a href='/{k}'> p  {k} </a>" * 3 if k % 2 else None for k in range(3 * PAGES)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "url": ["u"] * len(html), "html": html})
    out = list(anchor_rows([batch]))
    assert len(out) == 3 and max(b.num_rows for b in out) == 3 * PAGES // 2
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(k, "u", at, f"/{k}", f"p {k}") for k in range(1, len(html), 2) for at in range(3)]

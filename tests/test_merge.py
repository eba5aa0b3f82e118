"""Matching, conflicts and the versioned master on small fixtures."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.schema import KINDS, LISTING
from ledgerline.functions.similarity import may_reach, scored_pairs
from ledgerline.operators.match import match_batch
from ledgerline.operators.resolve import duplicate_groups, field_choices
from ledgerline.operators.stale import stale_candidates
from ledgerline.plans.checkpoints import writer
from ledgerline.plans.merge import apply_merge, build_plan, default_inserts, default_updates, manual_edit, status_line
from ledgerline.plans.table import MasterTable, Staging
from ledgerline.sources import mapping
from ledgerline.sources.documents import explode_units
from ledgerline.sources.xlsx import formula_fallback, read_cells, sheet_headers, sheet_table, write_workbook
from ledgerline.streaming.ingest import run_available


def rows(spark, *dicts):
    cols = list(KINDS)
    data = [(*[d.get(c) for c in cols], i) for i, d in enumerate(dicts)]
    return spark.createDataFrame(data, LISTING.add("_pos", "long") if "_pos" not in LISTING.fieldNames() else LISTING)


def row(building, floor="1", provider="P", **more):
    return {"building": building, "floor_unit": floor, "provider": provider, **more}


def tiers(spark, batch, master):
    got = match_batch(batch.withColumnRenamed("_pos", "_batch_pos"), master).select("_batch_pos", "match_tier", "master._pos").orderBy("_batch_pos").collect()
    return [tuple(r)[1:] for r in got]


def test_tiers(spark):
    master = rows(spark, row("A", postcode="E1 1AA"), row("A", postcode="E2 2BB"), row("B"), row("Heron House"), row("138 Heron Row"), row("Twin"), row("Twin"), row("Old Mill"), row("Old Mile"))
    batch = rows(spark, row("a.", postcode="e11aa"), row("A"), row("B", postcode="N1"), row("Heron Hause"), row("139 Heron Row"), row("Twin"), row("Old Mil"), row("B", floor="2"))
    assert tiers(spark, batch, master) == [("postcode", 0), (None, None), ("fallback", 2), ("fuzzy_building", 3), (None, None), (None, None), (None, None), (None, None)]


def test_ratio_matches_python(spark):
    words = ["heron house", "heron hause", "larch house", "tide", "diet", "", "a"]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    got = {(r.a, r.b): r.ratio for r in scored_pairs(pairs, "a", "b", 0.85).collect()}
    want = {(x, y): q for x, y in itertools.product(words, words) if (q := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.85}
    assert got == want
    assert pairs.where(~may_reach(F.col("a"), F.col("b"), 0.85)).where("a = b").count() == 0


@pytest.mark.parametrize(
    ("batch", "groups"),
    [
        ([row("X", postcode="E1"), row("x", postcode="e 1")], 1),
        ([row("X", postcode="E1"), row("X", postcode="E2")], 0),
        ([row("61 Marigold St"), row("Marigold Street")], 1),
        ([row("12 Larch St"), row("45 Larch Street")], 0),
        ([row("(33) Quince St"), row("33 Quince St")], 1),
        ([], 0),
    ],
)
def test_duplicates(spark, batch, groups):
    got = duplicate_groups(rows(spark, *batch), writer(spark)).select("component").distinct().count()
    assert got == groups


def test_field_choice(spark):
    b = rows(spark, row("A", contacts="22 desks"), row("A", contacts=""), row("A", contacts=None, state_of_space="Fitted"), row("A", state_of_space="CAT A", rent_pcm=1.0))
    got = {r.field: (r.needs_choice, r.value) for r in field_choices(b, "building", ["contacts", "state_of_space", "rent_pcm"]).collect()}
    assert got == {"contacts": (False, "22 desks"), "state_of_space": (True, None), "rent_pcm": (False, "1.0")}


def test_stale(spark):
    c = "Fernhill Estates"
    master = rows(spark, row("A", "1", c), row("A", "2", c), row("B", "1", c), row("A", "2", "Other"), row("C", "1", c))
    batch = rows(spark, row("A", "1", c + " Availability"))
    matched = spark.createDataFrame([(0,)], "_pos long")
    full = spark.createDataFrame([(c, "c")], "provider string, building string")
    assert sorted(r._pos for r in stale_candidates(batch, master, matched, fully_occupied=full, snapshot=[c]).collect()) == [1, 4]


def test_plan_and_table(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/master")
    assert table.read().count() == 0
    first = rows(spark, row("A", rent_pcm=1.0, source_file="a"), row("B", source_file="a"), row("B", "2", source_file="a"))
    table.write(first)
    batch = rows(spark, row("A", rent_pcm=2.0, source_file="b"), row("B", source_file="b"), row("9 New St", source_file="b"), row("New Street", source_file="c"))
    plan = build_plan(batch, table.read(), writer(spark))
    assert status_line(plan, 2) == "2 uploads pending — 2 new properties, 1 property with changes"
    merged = apply_merge(plan.master, default_updates(plan), default_inserts(plan))
    version = table.write(merged)
    got = {(r.building, r.floor_unit): (r.rent_pcm, r.source_file) for r in table.read().collect()}
    assert got[("A", "1")] == (2.0, "b") and got[("B", "2")] == (None, "a") and len(got) == 4
    new = [v for (b, _), v in got.items() if b.endswith(("St", "Street"))]
    assert new == [(None, "b + c")]
    assert all(r.property_id for r in table.read().collect())
    again = default_updates(build_plan(batch, table.read(), writer(spark)))
    assert again.where("field <> 'source_file'").isEmpty()
    edited, diff = manual_edit(table.read(), spark.createDataFrame([(0, "building", "Z"), (0, "nope", "x")], "pos long, field string, value string"))
    assert [tuple(r) for r in diff.select("field", "new").collect()] == [("building", "Z")] and edited.count() == 4
    table.restore(f"file://{tmp_path}/master/versions/" + sorted(p.name for p in (tmp_path / "master/versions").iterdir())[0])
    assert table.read().count() == 3 and table.versions().count() == 3 and version.split("/")[-1] < table.current().split("/")[-1]
    assert table.read_log().where("success").count() == 3


def test_staging(spark, tmp_path):
    s = Staging(spark, f"file://{tmp_path}/staging")
    assert s.union().count() == 0
    a = s.save(rows(spark, row("A"), row(" ")), "one.xlsx", "h1")
    b = s.save(rows(spark, row("B")), "two.xlsx", "h2")
    assert s.union().count() == 2 and s.pending().first()["filename"] == "two.xlsx"
    s.approve(a)
    s.discard(b)
    assert s.pending().count() == 0 and s.batches().count() == 1


def test_stream(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/master")
    folder = str(tmp_path / "in")
    rows(spark, row("A"), row("B")).drop("_pos").coalesce(1).write.parquet(folder)
    for _ in range(2):
        run_available(spark, folder, table, str(tmp_path / "cp"), writer(spark))
    assert table.read().count() == 2
    rows(spark, row("A", rent_pcm=3.0), row("C")).drop("_pos").coalesce(1).write.mode("append").parquet(folder)
    run_available(spark, folder, table, str(tmp_path / "cp"), writer(spark))
    assert sorted(r.building for r in table.read().collect()) == ["A", "B", "C"]


def test_mapping():
    m = mapping.suggest_mapping(["Building", "Floor/Unit", "Size (sq ft)", "Rent PCM", "Special Feature", "For Sale", "Min. Term", "Property Postcode"])
    assert m == {"Building": "building", "Floor/Unit": "floor_unit", "Size (sq ft)": "size_sqft", "Rent PCM": "rent_pcm", "Special Feature": "special_features", "For Sale": None, "Min. Term": None, "Property Postcode": "postcode"}
    run = ["Shoreditch", "Floor", "Current spec", "Size sq.ft", "Minimum Term", "Monthly Rate", "Price p/sq.ft", "Brochure"]
    assert mapping.structural_header(run, "UNION - Shoreditch.xlsx") == "Shoreditch"
    assert mapping.resolve(run, "UNION - Shoreditch.xlsx")[1] == []
    assert mapping.resolve(run, "other.xlsx")[1] == ["building"]
    assert mapping.guess_provider("Acme Estates Availability (final) 12-03-2026.xlsx") == "Acme Estates"
    assert mapping.guess_provider("union availability.xlsx") == "UNION" and mapping.guess_provider("Unionville July 2026.xlsx") == "Unionville"


def test_xlsx(spark, tmp_path):
    labels = ["Building", "Floor/Unit", "Size (sq ft)", "Brochure"]
    data = write_workbook([{"a": "A & B", "b": "1", "c": 12.5, "d": "https://example.org/x.pdf"}, {"a": " ", "b": "2", "c": 1, "d": None}], list("abcd"), labels)
    (tmp_path / "t.xlsx").write_bytes(data)
    cells = read_cells(spark, str(tmp_path)).cache()
    headers = sheet_headers(cells)
    assert headers == labels
    out = mapping.build_rows(sheet_table(cells, headers), mapping.suggest_mapping(headers), "t.xlsx").collect()
    assert [(r.building, r.size_sqft, r.brochure_link, r.source_file) for r in out] == [("A & B", 12.5, "https://example.org/x.pdf", "t.xlsx")]
    f = '=IFERROR(__xludf.DUMMYFUNCTION("a(b)"),"say ""x""")'
    assert spark.range(1).select(formula_fallback(F.lit(f))).first()[0] == 'say "x"'


def test_units(spark):
    j = '{"provider": "P", "contacts": "c", "units": [{"floor_unit": "0"}, {"building": "A", "floor_unit": "1", "size_sqft": 120, "rent_pcm": 100}, {"building": "", "floor_unit": "2"}]}'
    got = explode_units(spark.createDataFrame([("f", j)], "file string, json string")).orderBy("_pos").collect()
    assert [(r.building, r.floor_unit, r.provider, r.internal_ref, r.rent_psf) for r in got] == [("A", "1", "P", "P", 10.0), ("A", "2", "P", "P", None)]

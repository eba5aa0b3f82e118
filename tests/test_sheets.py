"""Sheet blocks, page geometry, geocoding, enrichment and display on literal fixtures."""

from pyspark.sql import functions as F

from ledgerline.functions.schema import KINDS, LISTING
from ledgerline.operators import display, geocode, geometry, sheets
from ledgerline.operators.enrich import enrich
from ledgerline.operators.links import best_links, resolve_email_links
from ledgerline.plans.merge import select_properties


def listing(spark, *dicts):
    return spark.createDataFrame([(*[d.get(c) for c in KINDS], i) for i, d in enumerate(dicts)], LISTING if "_pos" in LISTING.fieldNames() else LISTING.add("_pos", "long"))


def lines(spark, sheet, *texts, file="f"):
    return spark.createDataFrame([(file, sheet, i + 1, t.split("|")) for i, t in enumerate(texts)], "file string, sheet string, row_no int, cells array<string>")


SHEET = ["Offices updated 31/02/26", "Kent House - Soho|", "updated 1/3/26", "12 Kent Street|W1 1AA|Brochure (https://e.org/a.pdf)", "Floor|Size|Rent", "1|100|10", "2|200|20", "Download", "Other House", "9 Other Street", "Floor|Size|Rent", "3|1|1", "Download"]


def test_blocks(spark):
    ls = lines(spark, "s", *SHEET)
    units = spark.createDataFrame([("f", "s", 0, "Kent House", None, None, "Other House"), ("f", "s", 1, "Other House", None, "x", None)], "file string, sheet string, pos int, building string, postcode string, brochure_link string, next_building string")
    bounds = {r.building: (r.start, r.end) for r in sheets.block_bounds(ls, units).collect()}
    assert bounds == {"Kent House": (2, 13), "Other House": (9, 14)}
    assert {r.building: r.apparent for r in sheets.apparent_rows(ls, sheets.block_bounds(ls, units)).collect()} == {"Kent House": 5, "Other House": 1}
    assert [r.building for r in sheets.undercounted(ls, units).collect()] == ["Kent House"]
    assert [r.building for r in sheets.missing_links(ls, units).collect()] == ["Kent House"]
    assert {r.building: r.brochure_link for r in sheets.apply_block_links(units, ls).collect()} == {"Kent House": "https://e.org/a.pdf", "Other House": "x"}
    assert sheets.update_dates(ls).first().updated.isoformat() == "2026-03-01"
    assert sheets.block_bounds(lines(spark, "s", "Kent House", "a|b|c"), units).count() == 0


def test_house_numbers(spark):
    ls = lines(spark, "s", "Kent House", "12 Kent Street|x", "Other House", "14 Other Street|EC1 2AB", "Third", "1 A", "2 B")
    units = spark.createDataFrame([("f", "s", 0, "Kent House", None, "Other House"), ("f", "s", 1, "Other House", "ec1 2ab", None), ("f", "s", 2, "Third", None, None)], "file string, sheet string, pos int, building string, postcode string, next_building string")
    assert {r.pos: r.number for r in sheets.raw_house_numbers(ls, units).collect()} == {0: "12", 1: "14"}


def test_sheet_lines(spark):
    cells = spark.createDataFrame([("f", "s", 1, 1, "a\nb", None), ("f", "s", 1, 3, "c", "https://e.org"), ("f", "s", 2, 1, " ", None)], "file string, sheet string, row_no int, col_no int, value string, hyperlink string")
    assert [r.cells for r in sheets.sheet_lines(cells).collect()] == [["a b", "", "c (https://e.org)"]]


def test_classify(spark):
    old = lines(spark, "Old", "updated 1/1/2025", "Download")
    new = lines(spark, "New", "updated 1/1/2026", "Download")
    flat = lines(spark, "Flat", *["a|b|1|2|c"] * 5)
    hidden = lines(spark, "H", "x")
    names = spark.createDataFrame([("f", n, "hidden" if n == "H" else "visible") for n in ("Old", "New", "Flat", "H", "Summary")], "file string, sheet string, sheet_state string")
    got = {r.sheet: (r.outcome, r.reasons) for r in sheets.classify_sheets(names, old.union(new).union(flat).union(hidden)).collect()}
    assert got == {"Old": ("ambiguous", ["stale_update_date_vs_siblings"]), "New": ("authoritative", []), "Flat": ("ambiguous", ["flat_summary_table_with_no_brochure_links"]), "H": ("auto_skip", ["hidden_with_no_download_lines"]), "Summary": ("ambiguous", ["suspicious_sheet_name"])}


def test_geometry(spark):
    words = spark.createDataFrame([(0, 10.0, 0.0, 40.0, 8.0, "Brochure"), (0, 0.0, 20.0, 5.0, 28.0, "1,200"), (0, 0.0, 60.0, 5.0, 68.0, "Third"), (0, 0.0, 61.0, 9.0, 69.0, "third"), (1, 0.0, 0.0, 1.0, 8.0, "x")], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    links = spark.createDataFrame([(0, "a", 10.0, 22.0, 30.0, 30.0), (0, "b", 12.0, 58.0, 30.0, 66.0), (0, "far", 300.0, 58.0, 330.0, 66.0), (0, "tall", 10.0, 20.0, 30.0, 90.0), (1, "c", 0.0, 0.0, 5.0, 8.0)], "page int, uri string, x0 double, y0 double, x1 double, y1 double")
    units = spark.createDataFrame([(1, 0, "Ground", 1200.0), (2, 0, "Third Floor", None), (3, 1, "x", None)], "unit_id int, page int, floor_unit string, size_sqft double")
    assert {r.unit_id: r.uri for r in geometry.attach_links(words, links, units).collect()} == {1: "a", 2: "b"}


def test_geocode(spark):
    rows = listing(spark, {"building": "A", "address_1": "1 X St", "postcode": "E1"}, {"building": "B House, 2 Y St"}, {"building": "C"}, {"building": "D", "lat": 51.5, "lng": -0.1}, {"building": "E"})
    parts = [("1", ["street_number"]), ("X Street", ["route"]), ("E1 1AA", ["postal_code"]), ("Soho", ["neighborhood"])]
    responses = spark.createDataFrame(
        [("1 X St, E1, UK", "geocode", "OK", 51.51, 0.0, []), ("51.51,0.0", "reverse", "OK", None, None, parts), ("51.52,0.0", "reverse", "OK", None, None, parts), ("2 Y St, London, UK", "places", "OK", 51.52, 0.0, parts), ("C, London, UK", "places", "OK", 48.0, 0.0, parts), ("51.5,-0.1", "reverse", "OK", None, None, parts), ("E, London, UK", "places", "OK", None, None, None)],
        "query string, kind string, status string, lat double, lng double, components array<struct<name:string,types:array<string>>>",
    )
    got = {r.building: (r.lat, r.address_1, r.postcode, r.submarket, r.failure) for r in geocode.geocode_rows(rows, responses).collect()}
    assert got == {"A": (51.51, "1 X St", "E1", "Soho", None), "B House, 2 Y St": (51.52, "1 X Street", "E1 1AA", "Soho", None), "C": (None, None, None, None, geocode.OUTSIDE), "D": (51.5, None, None, "Soho", None), "E": (None, None, None, None, geocode.OUTSIDE)}


def test_enrich(spark):
    link = "https://e.org/brochure.pdf"
    rows = listing(spark, {"building": "A", "brochure_link": link, "floor_unit": "1"}, {"building": "A", "brochure_link": link, "size_sqft": 1000.0, "special_features": "own"}, {"building": "A", "brochure_link": "https://youtu.be/x", "floor_unit": "1"}, {"building": "A", "brochure_link": link, "size_sqft": 500.0})
    units = spark.createDataFrame([(link, "a", "1", 100.0, "gym", "Fitted"), (link, "A.", "2", 1015.0, "bar", "CAT A"), (link, "A", "3", 505.0, "x", None), (link, "A", "4", 504.0, "y", None)], "url string, building string, floor_unit string, size_sqft double, special_features string, state_of_space string")
    got = {r._pos: (r.special_features, r.state_of_space, r.enriched) for r in enrich(rows, units).collect()}
    assert got == {0: ("gym", "Fitted", ["special_features", "state_of_space"]), 1: ("own", "CAT A", ["state_of_space"]), 2: (None, None, []), 3: (None, None, [])}


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://e.org/p/", '<a href="/home">Home</a><a href="b.pdf">x</a><a href="c.pdf">Our <b>Brochure</b></a>'), (2, "https://e.org", "<p>none</p>")], "page_id long, url string, html string")
    assert [tuple(r) for r in best_links(pages).collect()] == [(1, "https://e.org/p/c.pdf", 3)]
    text = "See <https://e.org/a.pdf> and <https://e.org/> " + "." * 120 + " unsubscribe <https://e.org/b> end"
    got = spark.range(1).select(resolve_email_links(F.lit(text))).first()[0]
    assert got.startswith("See https://e.org/a.pdf and  .") and "<" not in got and got.endswith("unsubscribe  end")
    near = "x <https://e.org/unsubscribe> or <https://e.org/prefs2> " + "." * 100 + " <https://e.org/kept/1>"
    assert spark.range(1).select(resolve_email_links(F.lit(near))).first()[0] == "x  or  " + "." * 100 + " https://e.org/kept/1"


def test_display(spark):
    rows = listing(spark, {"building": "A", "provider": "b", "address_1": "1 X", "floor_unit": "1", "property_id": "p"}, {"building": "B", "provider": "A", "address_1": "1 x", "floor_unit": "2", "property_id": "q"}, {"building": "C", "property_id": "r"})
    assert [r.building for r in rows.orderBy(*display.provider_order()).collect()] == ["B", "A", "C"]
    shown = display.visible_columns(rows)
    assert "desks_min" not in shown and "property_id" not in shown
    assert display.restore_hidden(rows.select(*shown), rows).columns == rows.columns
    assert display.search(rows, "(", ["building"]).count() == 0 and display.search(rows, "b", ["building", "provider"]).count() == 2
    assert {r._pos: r.label for r in display.property_labels(rows).collect()} == {0: "1 X — b — 1", 1: "1 x — A — 2", 2: "(no address)"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "property_id string")
    assert sorted(r[0] for r in select_properties(ids("p", "q"), ids("q", "r"), ids("r")).collect()) == ["p", "r"]
    assert [r["Building"] for r in display.export_rows(rows, ids("p", "q")).collect()] == ["B", "A"]

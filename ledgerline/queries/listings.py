"""Queries over whole operators: sheets and their warnings, geocoding tiers, geometry, links, edits and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.schema import KINDS, LISTING, spread
from ..functions.text import house_number_changed
from ..operators import diff, display, enrich, geocode, geometry, links, sheets
from ..plans.checkpoints import writer
from ..plans.merge import COLUMNS, manual_edit
from ..sources import mapping
from ..sources.documents import content_hash
from .adapter import sides, table, with_listing

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _listing(df, have: dict, *more):
    """df as listing rows: the columns in have, all others null."""
    return df.select(*[have.get(c, F.lit(None)).cast(LISTING[c].dataType).alias(c) for c in KINDS], *more)


def _expr(sql: str):
    return F.expr(sql.replace("VARCHAR", "STRING"))


# ---------------------------------------------------------------- mapping of foreign headers

_HEADERS = ["Building", "Floor/Unit", "Size (sq ft)", "Monthly Rate", "Property Postcode", "Legal Structure"]
_SIZE = "CASE l_orderkey % 3 WHEN 0 THEN 'POA' WHEN 1 THEN '1,' || CAST(100 + l_linenumber AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END"


@query(
    f"""SELECT 'B' || CAST(l_partkey % 97 AS VARCHAR) AS building, CAST(l_linenumber AS VARCHAR) AS floor_unit, CASE l_orderkey % 3 WHEN 1 THEN CAST(1100 + l_linenumber AS DOUBLE) WHEN 2 THEN CAST(l_partkey AS DOUBLE) END AS size_sqft, 'N1' AS postcode, 'sheet.xlsx' AS source_file, count(*) AS n
FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL"""
)
def map_rows(spark, sf):
    raw = ["CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE 'B' || CAST(l_partkey % 97 AS VARCHAR) END", "CAST(l_linenumber AS VARCHAR)", _SIZE, "'n/a'", "'N1'", "'x'"]
    sheet = table(spark, sf, "lineitem").select(*[_expr(x).alias(h) for x, h in zip(raw, _HEADERS, strict=True)])
    rows = mapping.build_rows(sheet, mapping.suggest_mapping(_HEADERS), "sheet.xlsx").where("rent_pcm is null")
    return rows.groupBy("building", "floor_unit", "size_sqft", "postcode", "source_file").agg(F.count("*").alias("n"))


_RENT = "CASE s_suppkey % 3 WHEN 0 THEN 'Monthly Rate' WHEN 1 THEN 'Monthly Rates' ELSE 'Montly Rate' END"
_CODE = "CASE WHEN s_suppkey % 2 = 0 THEN 'Postcode' ELSE 'Post-Code' END"


@query(
    f"""WITH h AS (SELECT s_suppkey, unnest(['Building', 'Floor/Unit', 'Size (sq ft)', {_RENT}, {_CODE}, 'Legal Structure', 'Supplier ' || s_nationkey]) AS header, unnest(['building', 'floor_unit', 'size_sqft', 'rent_pcm', 'postcode', NULL, NULL]) AS field FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS id, header, field FROM h"""
)
def header_fields(spark, sf):
    """Headers of one sheet for each supplier, some of them misspelt."""
    headers = ["'Building'", "'Floor/Unit'", "'Size (sq ft)'", _RENT, _CODE, "'Legal Structure'", "'Supplier ' || s_nationkey"]
    sheets_ = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(*map(F.expr, headers)).alias("headers"))
    return mapping.map_headers(sheets_)


_WHO = "translate(n_name, '_0123456789', ' abcdefghij')"
_FILE = f"""CASE s_suppkey % 4 WHEN 0 THEN 'Union availability June 26.xlsx' WHEN 1 THEN {_WHO} || ' Offices_2026-07-17.xlsx' WHEN 2 THEN {_WHO} || ' (draft ' || CAST(s_suppkey AS VARCHAR) || ') Sept 2026 live data.csv'
  ELSE '12-03-' || CAST(2000 + s_suppkey % 100 AS VARCHAR) || '.xlsx' END"""


@query(f"SELECT s_suppkey, {_FILE} AS file, CASE s_suppkey % 4 WHEN 0 THEN 'UNION' WHEN 1 THEN {_WHO} || ' Offices' WHEN 2 THEN {_WHO} ELSE '12-03-' || CAST(2000 + s_suppkey % 100 AS VARCHAR) END AS provider FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def file_providers(spark, sf):
    """A file name of each supplier and the provider that it tells."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", _expr(_FILE).alias("file")).withColumn("provider", mapping.guessed_provider("file"))


_NAMED = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) || ' ' || p_name END"


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Larch Offices' ELSE p_brand END AS provider, CASE WHEN p_partkey % 2 = 0 THEN 'Larch Offices' ELSE p_brand END AS internal_ref, CASE WHEN p_partkey % 5 = 0 THEN 'given' ELSE 'Soho' END AS submarket,
  CASE WHEN p_partkey % 7 = 0 THEN 'own' WHEN regexp_matches({_NAMED}, '[0-9]') THEN {_NAMED} END AS address_1 FROM part"""
)
def fill_rows(spark, sf):
    p = table(spark, sf, "part")
    have = {"building": _expr(_NAMED), "provider": F.when(F.col("p_partkey") % 2 > 0, F.col("p_brand")), "submarket": F.when(F.col("p_partkey") % 5 == 0, "given"), "address_1": F.when(F.col("p_partkey") % 7 == 0, "own")}
    return mapping.fill_from_file(_listing(p, have, "p_partkey"), "Larch Offices availability.xlsx", area="Soho").select("p_partkey", "provider", "internal_ref", "submarket", "address_1")


# ---------------------------------------------------------------- sheets of building blocks

# A supplier is a sheet of its nation's workbook: a heading, an address, a link or none, a table of 2 to 4 floors, a last download line.
_LINK = "'https://example.org/' || CAST(s_suppkey AS VARCHAR) || '.pdf'"


def _block_sheets(spark, sf):
    s = table(spark, sf, "supplier").select("*", F.col("s_nationkey").cast("string").alias("file"), F.col("s_suppkey").cast("string").alias("sheet"))
    k = F.col("s_suppkey")
    number = F.concat((k % 50 + 1).cast("string"), F.lit("a"))
    label = F.when(k % 4 > 0, F.concat(F.lit("Download Brochure ("), _expr(_LINK), F.lit(")"))).otherwise(F.lit("Download plans"))
    head = [F.array(F.concat("s_name", F.lit(" - City"))), F.array(F.concat(number, F.lit(" High Road"))), F.array(label), F.array(F.lit("Floor"), F.lit("Size"), F.lit("Rent"))]
    floors = F.transform(F.sequence(F.lit(1), (2 + k % 3).cast("int")), lambda i: F.array(F.concat(F.lit("Floor "), i.cast("string")), F.lit("100"), F.lit("5")))
    every = F.concat(F.array(*head), floors, F.array(F.array(F.lit("Download all"))))
    lines = s.select("file", "sheet", F.posexplode(every).alias("p", "cells")).select("file", "sheet", (F.col("p") + 1).alias("row_no"), "cells")
    address = F.when(k % 3 == 1, F.lit("High Road")).when(k % 3 == 2, F.concat(number, F.lit(" High Road")))
    units = s.select("file", "sheet", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos"), F.col("s_name").alias("building"), F.when(k % 7 == 0, "ZZ9 9ZZ").alias("postcode"), address.alias("address_1"), F.when(k % 11 > 0, 100.0).alias("size_sqft"), F.lit(None).cast("double").alias("rent_pcm"), F.lit(None).cast("double").alias("rent_psf"), F.when(k % 5 == 0, "https://example.org/own.pdf").alias("brochure_link"))
    return lines, units


_WARNINGS = """SELECT CAST(s_suppkey AS VARCHAR) AS sheet, 'undercounted' AS kind, CAST(2 + s_suppkey % 3 AS BIGINT) AS apparent, CAST(2 AS BIGINT) AS actual FROM supplier WHERE s_suppkey % 3 > 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'no_link', NULL, NULL FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 5 > 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'garbled', 2, 0 FROM supplier WHERE s_suppkey % 11 = 0"""


@query(_WARNINGS)
def sheet_warnings(spark, sf):
    return sheets.sheet_warnings(*_block_sheets(spark, sf)).select("sheet", "kind", "apparent", "actual")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS sheet, pos, CASE WHEN s_suppkey % 4 > 0 THEN {_LINK} WHEN s_suppkey % 5 = 0 THEN 'https://example.org/own.pdf' END AS brochure_link FROM supplier, (SELECT unnest([0, 1]) AS pos)")
def block_links(spark, sf):
    lines, units = _block_sheets(spark, sf)
    return sheets.apply_block_links(units, lines).select("sheet", "pos", "brochure_link")


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS sheet, pos, CASE WHEN s_suppkey % 3 = 1 AND s_suppkey % 7 > 0 OR s_suppkey % 3 = 2 THEN CAST(s_suppkey % 50 + 1 AS VARCHAR) || 'a High Road' WHEN s_suppkey % 3 = 1 THEN 'High Road' END AS address_1,
  CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 > 0 END AS verified FROM supplier, (SELECT unnest([0, 1]) AS pos)"""
)
def house_numbers(spark, sf):
    lines, units = _block_sheets(spark, sf)
    return sheets.verify_house_numbers(lines, units).select("sheet", "pos", "address_1", "verified")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sheet, 1 AS row_no, s_name || ' |  | map (https://example.org/map)' AS text FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 3, ' | two lines' FROM supplier")
def sheet_text(spark, sf):
    s = table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), v.alias("value"), h.alias("hyperlink")) for r, c, v, h in ((1, 1, F.col("s_name"), none), (1, 3, F.lit("map"), F.lit("https://example.org/map")), (2, 2, F.lit("  "), none), (3, 2, F.lit("two \n lines"), none), (3, 4, F.lit(" "), none))])
    flat = s.select(F.lit("f").alias("file"), F.col("s_suppkey").cast("string").alias("sheet"), F.inline(cells))
    return sheets.sheet_lines(flat).select("sheet", "row_no", sheets.line_text(F.col("cells")).alias("text"))


@query("SELECT source AS file, CAST(doc_id AS VARCHAR) AS sheet FROM documents WHERE doc_id % 9 = 0")
def occupied_sheets(spark, sf):
    d = table(spark, sf, "documents")
    first = F.when(F.col("doc_id") % 9 == 0, "  Fully OCCUPIED ").when(F.col("doc_id") % 9 == 1, "Fully occupied soon").otherwise("Floor")
    lines = d.select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("sheet"), F.lit(1).alias("row_no"), F.array(F.lit(None).cast("string"), first, F.col("text")).alias("cells"))
    return sheets.fully_occupied_sheets(lines)


# ---------------------------------------------------------------- geocoding


@query(
    """WITH s AS (SELECT c_custkey AS pos, 51.5 + (c_custkey * 7919 % 1009) / 100000.0::DOUBLE AS lat, -0.1 + (c_custkey * 7477 % 997) / 100000.0::DOUBLE AS lng FROM customer),
a AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, 51.5 + (o_orderkey * 31 % 331) / 33000.0::DOUBLE AS lat, -0.1 + (o_orderkey * 17 % 313) / 31000.0::DOUBLE AS lng FROM orders WHERE o_orderkey % 7 = 0),
p AS (SELECT pos, key, round(sqrt(pow(s.lng * 69298.3293504998 - a.lng * 69298.3293504998, 2) + pow(s.lat * 111320.0::DOUBLE - a.lat * 111320.0::DOUBLE, 2)), 6) AS far FROM s JOIN a ON abs(s.lat - a.lat) < 0.001)
SELECT pos, arg_min(key, (far, key)) AS key FROM p WHERE far <= 25 GROUP BY pos"""
)
def nearest_answers(spark, sf):
    """Customers at made coordinates with the nearest of answers at others, some of which share one place."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    spots = table(spark, sf, "customer").select(k.alias("pos"), (F.lit(51.5) + (k * 7919 % 1009) / F.lit(100000.0)).alias("lat"), (F.lit(-0.1) + (k * 7477 % 997) / F.lit(100000.0)).alias("lng"))
    answers = table(spark, sf, "orders").where(o % 7 == 0).select(o.cast("string").alias("key"), (F.lit(51.5) + (o * 31 % 331) / F.lit(33000.0)).alias("lat"), (F.lit(-0.1) + (o * 17 % 313) / F.lit(31000.0)).alias("lng"))
    return spots.join(geocode.nearest(spots, answers, "key", checkpoint=writer(spark)), ["lat", "lng"]).select("pos", "answer.key")


@query(
    """SELECT c_custkey AS pos, CAST(CASE c_custkey % 6 WHEN 0 THEN 51.5 WHEN 1 THEN 51.51 WHEN 2 THEN 51.52 WHEN 5 THEN 51.55 END AS DOUBLE) AS lat,
  CASE c_custkey % 6 WHEN 0 THEN 'own road' WHEN 1 THEN CAST(c_custkey AS VARCHAR) || ' Quince Row' WHEN 2 THEN '9 Plover Street' END AS address_1, CASE c_custkey % 6 WHEN 0 THEN 'N1 1AA' WHEN 1 THEN 'N1 2BB' WHEN 2 THEN 'N1 3CC' END AS postcode, CASE c_custkey % 6 WHEN 0 THEN 'Angel' WHEN 2 THEN 'Barbican' END AS submarket,
  CASE c_custkey % 6 WHEN 3 THEN 'the place found lies outside London' WHEN 4 THEN 'neither address nor place found' WHEN 5 THEN 'coordinates found, but no street address or postcode there' END AS failure FROM customer"""
)
def geocode_tiers(spark, sf):
    """Customers that are found by address, by the address part of their building, by the whole building, outside London, not at all, and without an address."""
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 6)
    k, ident = F.col("k"), F.col("c_custkey").cast("string")
    part = F.when(k == 1, F.concat(ident, F.lit(" Quince Row"))).when(k == 2, F.concat(ident, F.lit(" Far Row")))
    building = F.when(part.isNotNull(), F.concat(F.lit("Heron Hall, "), part)).otherwise(F.concat(F.lit("Larch House "), ident))
    have = {"building": building, "address_1": F.when(k == 0, "own road"), "postcode": F.when(k == 0, "N1 1AA")}
    rows = _listing(c, have, F.col("c_custkey").alias("_pos"))
    none = "cast(array() as array<struct<name:string,types:array<string>>>)"
    names = "array(struct(concat(cast(c_custkey as string)) as name, array('street_number') as types), struct('Quince Row' as name, array('route') as types), struct('N1 2BB' as name, array('postal_code', 'x') as types))"
    there = "array(struct('9' as name, array('street_number') as types), struct('Plover Street' as name, array('route') as types), struct('N1 3CC' as name, array('postal_code') as types), struct('Barbican' as name, array('neighborhood') as types))"
    angel = "array(struct('Angel' as name, array('sublocality') as types), struct('1' as name, array('street_number') as types))"
    told = [
        ("k = 0", "'own road, N1 1AA, UK'", "geocode", "51.5", none),
        ("k = 0", "'51.5,0.0'", "reverse", "0.0", angel),
        ("k = 1", "concat(c_custkey, ' Quince Row, London, UK')", "places", "51.51", names),
        ("k = 2", "concat(c_custkey, ' Far Row, London, UK')", "places", "48.0", none),
        ("k = 2", "concat('Heron Hall, ', c_custkey, ' Far Row, London, UK')", "places", "51.52", none),
        ("k = 2", "'51.52,0.0'", "reverse", "0.0", there),
        ("k = 3", "concat('Larch House ', c_custkey, ', London, UK')", "places", "48.0", none),
        ("k = 5", "concat('Larch House ', c_custkey, ', London, UK')", "places", "51.55", none),
    ]
    responses = None
    for where, ask, kind, lat, parts in told:
        some = c.where(where).selectExpr(f"{ask} as query", f"'{kind}' as kind", "'OK' as status", f"cast({lat} as double) as lat", "cast(0 as double) as lng", f"{parts} as components").distinct()
        responses = some if responses is None else responses.unionByName(some)
    return geocode.geocode_rows(rows, responses).select(F.col("_pos").alias("pos"), "lat", "address_1", "postcode", "submarket", "failure")


# ---------------------------------------------------------------- page geometry


def _pages(spark, sf):
    """A supplier is a page of two units; headings mark a brochure column, a floor plan column in one word or two, or none."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"))
    k = F.col("page") % 4

    def boxes(df, *rows):
        each = [F.when(c, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)])) for c, names, r in rows]
        return df.select("page", F.inline(F.array_compact(F.array(*each))))

    box = ("x0", "y0", "x1", "y1", "text")
    always = F.lit(True)
    words = boxes(s, (always, box, (0.0, 100.0, 50.0, 110.0, "Ground")), (always, box, (0.0, 200.0, 50.0, 210.0, "First")), (always, box, (60.0, 300.0, 90.0, 310.0, "office")), (k == 1, box, (100.0, 0.0, 140.0, 10.0, "Brochure:")), (k == 2, box, (300.0, 0.0, 340.0, 10.0, "floorplan")), (k == 3, box, (300.0, 0.0, 320.0, 10.0, "Floor")), (k == 3, box, (325.0, 1.0, 345.0, 11.0, "Plan")))
    link = ("uri", "x0", "y0", "x1", "y1")
    spots = boxes(s, (always, link, ("ground", 110.0, 101.0, 130.0, 109.0)), (always, link, ("ground plan", 310.0, 101.0, 330.0, 109.0)), (always, link, ("first", 110.0, 206.0, 130.0, 214.0)), (always, link, ("first plan", 310.0, 206.0, 330.0, 214.0)), (always, link, ("", 110.0, 101.0, 130.0, 109.0)), (always, link, ("picture", 110.0, 100.0, 130.0, 160.0)))
    units = s.select("page", F.explode(F.array(F.lit("Ground floor"), F.lit("First floor of 2"))).alias("floor_unit")).select((F.col("page") * 2 + (F.col("floor_unit") == "Ground floor").cast("int")).alias("unit_id"), "page", "floor_unit", F.lit(None).cast("double").alias("size_sqft"))
    return words, spots, units


@query("SELECT s_suppkey * 2 + g AS unit_id, CASE WHEN g = 1 THEN 'ground' ELSE 'first' END AS uri FROM supplier, (SELECT unnest([0, 1]) AS g) WHERE s_suppkey % 4 > 0")
def column_links(spark, sf):
    return geometry.attach_links(*_pages(spark, sf))


@query("SELECT s_suppkey AS page, CASE WHEN s_suppkey % 4 = 1 THEN 'brochure' ELSE 'floor plan' END AS kind, CAST(CASE WHEN s_suppkey % 4 = 1 THEN 60 ELSE 260 END AS DOUBLE) AS lo, CAST(CASE s_suppkey % 4 WHEN 1 THEN 150 WHEN 2 THEN 350 ELSE 355 END AS DOUBLE) AS hi FROM supplier WHERE s_suppkey % 4 > 0")
def column_ranges(spark, sf):
    return geometry.column_ranges(_pages(spark, sf)[0])


@query("SELECT s_suppkey * 2 + g AS unit_id, s_suppkey AS page, CAST(CASE WHEN g = 1 THEN 105 ELSE 205 END AS DOUBLE) AS y FROM supplier, (SELECT unnest([0, 1]) AS g)")
def unit_rows(spark, sf):
    words, _, units = _pages(spark, sf)
    return geometry.row_heights(words, units)


@query("SELECT s_suppkey AS page, CASE WHEN s_suppkey % 4 = 1 THEN 'Brochure: small' ELSE 'small' END AS caption FROM supplier")
def caption_words(spark, sf):
    words, _, _ = _pages(spark, sf)
    more = words.select("page").distinct().select("page", F.lit(120.0).alias("x0"), F.lit(11.0).alias("y0"), F.lit(125.0).alias("x1"), F.lit(15.0).alias("y1"), F.lit("small").alias("text"))
    spot = more.select("page", F.lit("u").alias("uri"), F.lit(118.0).alias("x0"), F.lit(11.0).alias("y0"), F.lit(126.0).alias("x1"), F.lit(14.0).alias("y1"))
    return geometry.caption_texts(words.unionByName(more), spot).select("page", "caption")


# ---------------------------------------------------------------- links, diffs and enrichment


@query("SELECT p_partkey, 'See https://a.example.org/x/' || CAST(p_partkey AS VARCHAR) || ' ' || p_name || ' and  or ' || repeat('-', 40) || '  end  more https://a.example.org/last/z' AS body FROM part")
def email_links(spark, sf):
    text = F.concat(F.lit("See <https://a.example.org/x/"), F.col("p_partkey").cast("string"), F.lit("> "), "p_name", F.lit(f" and <https://a.example.org/unsubscribe> or {'-' * 40} <https://b.example.org/prefs> end <https://example.org/> more <https://a.example.org/last/z>"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", links.resolve_email_links(text).alias("body"))


_RAW_LINK = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://a.example.org/u/' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'https://example.org/' WHEN 3 THEN '' ELSE 'https://a.example.org/unsubscribe?u=1' END"


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 1 AND page_id % 2 = 0 THEN url WHEN page_id % 5 = 1 THEN {_RAW_LINK} WHEN page_id % 3 = 0 THEN 'file.pdf' END AS link FROM pages")
def final_links(spark, sf):
    resolved = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return table(spark, sf, "pages").select("page_id", links.finalize_link(_expr(_RAW_LINK), resolved, F.col("page_id") % 3 == 0, F.lit("file.pdf")).alias("link"))


@query("SELECT page_id, page_id % 4 = 0 AND regexp_matches(url, '^https?://[^/?#]+(/+[^/?#]|/*[^?#]*[?][^#])') AS eligible FROM pages")
def eligible_links(spark, sf):
    u = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(url, '/Floorplan') WHEN 2 THEN 'https://youtu.be/x' ELSE 'ftp://example.org/a' END")
    return table(spark, sf, "pages").select("page_id", enrich.eligible_url(u).alias("eligible"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'special_features,address_1' WHEN p_partkey % 2 = 1 THEN 'address_1' ELSE '' END AS risky, CASE WHEN p_partkey % 4 = 3 THEN 'special_features' ELSE '' END AS gone, p_partkey % 2 = 1 AS renumbered FROM part")
def risky_changes(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 1, "gym hall").when(k % 4 == 2, "alpha terrace; gym hall; pool").when(k % 4 == 3, "let; alpha terrace; gym hall").otherwise("alpha terrace; gym hall")
    number = lambda more: F.concat((F.col("p_size") + more).cast("string"), F.lit(" "), F.col("p_name"))
    old = _listing(spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name")), {"building": F.lit("B"), "special_features": F.lit("alpha terrace; gym hall"), "address_1": number(F.lit(0))}, "p_partkey", text.alias("t"), number(k % 2).alias("a"))
    rows = old.select("p_partkey", F.struct(*COLUMNS).alias("o"), F.struct(*[{"special_features": F.col("t"), "address_1": F.col("a")}.get(c, F.col(c)).alias(c) for c in COLUMNS]).alias("n"))
    rows, diffs = rows.withColumn("diffs", diff.field_diffs(F.col("o"), F.col("n"))), F.col("diffs")
    return rows.select("p_partkey", F.array_join(diff.risky_fields(F.col("o"), F.col("n"), diffs), ",").alias("risky"), F.array_join(diff.let_status_fields(F.col("n"), diffs), ",").alias("gone"), house_number_changed(F.col("o.address_1"), F.col("n.address_1")).alias("renumbered"))


@query(
    """SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 1 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'unit ' || CAST(p_partkey AS VARCHAR) END AS special_features, CASE WHEN p_partkey % 3 = 0 THEN 'Fitted' ELSE '' END AS state_of_space,
  CASE WHEN p_partkey % 3 > 0 THEN '' WHEN p_partkey % 2 = 1 THEN 'state_of_space' ELSE 'special_features,state_of_space' END AS enriched FROM part"""
)
def enrich_rows(spark, sf):
    p, ident = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://b.example.org/"), (F.col("p_partkey") % 50).cast("string"))
    have = {"building": F.concat(F.lit("B "), ident), "floor_unit": F.lit("1"), "brochure_link": url, "special_features": F.when(F.col("p_partkey") % 2 == 1, "own"), "state_of_space": F.lit("")}
    units = p.where("p_partkey % 3 = 0").select(url.alias("url"), F.concat(F.lit("b. "), ident).alias("building"), F.lit("1").alias("floor_unit"), F.lit(1.0).alias("size_sqft"), F.concat(F.lit("unit "), ident).alias("special_features"), F.lit("Fitted").alias("state_of_space"))
    out = enrich.enrich(_listing(p, have, F.col("p_partkey").alias("_pos")), units)
    return out.select(F.col("_pos").alias("pos"), "special_features", "state_of_space", F.array_join("enriched", ",").alias("enriched"))


# ---------------------------------------------------------------- edits, columns, export


@query(with_listing("SELECT pos, CASE WHEN pos % 13 = 0 THEN 'Z' ELSE building END AS building, CASE WHEN pos % 26 = 0 THEN 7.5 ELSE size_sqft END AS size_sqft, CASE WHEN pos % 13 = 0 THEN NULL ELSE postcode END AS postcode FROM master"))
def manual_edits(spark, sf):
    """Edits of a name, of a number in numbers and in words, of a field to nothing, and of no field."""
    _, master = sides(spark, sf)
    told = {"building": F.lit("Z"), "size_sqft": F.when(F.col("_pos") % 26 == 0, "7.5").otherwise("a few"), "postcode": F.lit(None).cast("string"), "no_field": F.lit("x")}
    edits = master.where("_pos % 13 = 0").select(F.col("_pos").alias("pos"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in told.items()])).alias("e")).select("pos", "e.*")
    return manual_edit(master, edits)[0].select(F.col("_pos").alias("pos"), "building", "size_sqft", "postcode")


@query(with_listing("SELECT pos, upper(building) AS building, CAST(pos AS VARCHAR) AS property_id FROM master"))
def hidden_columns(spark, sf):
    """Rows edited as they are shown, without lineage and a column that no row has, and put together again."""
    _, master = sides(spark, sf)
    master = master.withColumn("property_id", F.col("_pos").cast("string"))
    shown = [c for c in display.visible_columns(master) if c not in ("property_id", "desks_min")]
    back = display.restore_hidden(master.select(*shown).withColumn("building", F.upper("building")), master)
    return back.select(F.col("_pos").alias("pos"), "building", "property_id")


@query(with_listing("""SELECT building AS "Building", provider AS "Provider", size_sqft AS "Size Sqft" FROM master WHERE pos % 17 = 0"""))
def export_table(spark, sf):
    _, master = sides(spark, sf)
    rows = master.withColumn("property_id", F.col("_pos").cast("string"))
    return display.export_rows(rows, rows.where("_pos % 17 = 0").select("property_id")).select("Building", "Provider", "Size Sqft")


@query(r"SELECT c_custkey, sha256('v1'::BLOB || '\x00'::BLOB || encode(c_name) || '\x00'::BLOB || '{}'::BLOB) AS content_hash FROM customer")
def content_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", content_hash(F.encode("c_name", "UTF-8"), "v1").alias("content_hash"))

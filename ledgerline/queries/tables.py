"""Queries over windows, aggregates, sheets, geometry, geocoding, logs and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import display, geocode, geometry, sheets
from ..plans.merge import select_properties
from ..plans.table import latest_uploads, with_last_entry
from ..sources.documents import inherit_building
from .adapter import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KIND = "CASE WHEN event_id % 3 = 0 THEN event_type END"


@query(f"SELECT * FROM (SELECT event_id, last_value({_KIND} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS building FROM events) WHERE building IS NOT NULL")
def carry_forward(spark, sf):
    units = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("_pos"), F.coalesce(F.expr(_KIND), F.lit("")).alias("building"))
    return inherit_building(units).select(F.col("_pos").alias("event_id"), "building")


@query(
    """WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS head FROM events), b AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
r AS (SELECT user_id, run, lead(min(event_type)) OVER (PARTITION BY user_id ORDER BY run) AS next FROM b GROUP BY user_id, run) SELECT event_id, next FROM b JOIN r ON b.user_id = r.user_id AND b.run = r.run"""
)
def next_distinct(spark, sf):
    units = table(spark, sf, "events").select(F.lit("f").alias("file"), F.col("user_id").cast("string").alias("sheet"), F.col("event_id").alias("pos"), F.col("event_type").alias("building"))
    return sheets.with_next_building(units).select(F.col("pos").alias("event_id"), F.col("next_building").alias("next"))


@query("SELECT user_id, list_sort(list(value))[CAST(floor(count(value) / 2.0) AS BIGINT) + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(geometry.upper_median("value").alias("median"))


@query("SELECT a.user_id, a.event_type, max(b.last) AS newest_other FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) a LEFT JOIN (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1, 2")
def newest_sibling(spark, sf):
    dates = table(spark, sf, "events").groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("sheet")).agg(F.max("ts").alias("updated"))
    return sheets.newest_siblings(dates).select(F.col("file").alias("user_id"), F.col("sheet").alias("event_type"), F.col("newest").alias("newest_other"))


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(lower(c_name), '[3-5]9|^b.*ing$') OR regexp_matches(lower(c_mktsegment), '[3-5]9|^b.*ing$')")
def search_filter(spark, sf):
    return display.search(table(spark, sf, "customer"), " [3-5]9|^B.*ing$ ", ["c_name", "c_mktsegment", "no_such_column"]).select("c_custkey", "c_name")


@query("(SELECT c_custkey AS property_id FROM customer WHERE c_custkey % 3 = 0 AND NOT c_acctbal > 0) UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 5 = 0")
def selection_set(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "property_id")
    seen = c.where("c_acctbal > 0")
    old = c.where("property_id % 3 = 0").select("property_id")
    return select_properties(old, seen.select("property_id"), seen.where("property_id % 5 = 0").select("property_id"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name IS NULL, lower(s_name), s_suppkey LIMIT 10")
def provider_sort(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_pos"), F.col("s_name").alias("provider"))
    return rows.orderBy(*display.provider_order()).limit(10).select(F.col("_pos").alias("s_suppkey"), F.col("provider").alias("s_name"))


@query(
    """WITH v AS (SELECT DISTINCT user_id AS version FROM events), l AS (SELECT user_id AS version, max(ts) AS stamp, max_by(event_type, ts) AS source FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT v.version, l.stamp FROM v LEFT JOIN l ON v.version = l.version"""
)
def version_log(spark, sf):
    e = table(spark, sf, "events")
    log = e.where("event_id % 2 = 0").select(F.col("user_id").alias("version_path"), F.col("ts").alias("timestamp"), F.col("event_type").alias("source"))
    return with_last_entry(e.select(F.col("user_id").alias("version_path")).distinct(), log).select(F.col("version_path").alias("version"), F.col("timestamp").alias("stamp"))


@query("SELECT o_orderpriority AS content_hash, max(o_orderkey) AS path FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderpriority) AS last FROM orders) WHERE o_orderdate = last GROUP BY 1")
def latest_upload(spark, sf):
    batches = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("content_hash"))
    return latest_uploads(batches).select("content_hash", "path")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_of_each(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return first.select("l_partkey", "m.l_orderkey", "m.l_linenumber")


@query(
    """WITH a AS (SELECT doc_id, count(*) OVER (PARTITION BY source) AS n, source, lang FROM documents) SELECT doc_id, source || ' — ' || lang || CASE WHEN n > 1 THEN ' — ' || CAST(doc_id AS VARCHAR) ELSE '' END AS label FROM a"""
)
def new_labels(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("_pos"), F.col("source").alias("address_1"), F.col("lang").alias("provider"), F.col("doc_id").cast("string").alias("floor_unit"))
    return display.property_labels(rows).select(F.col("_pos").alias("doc_id"), "label")


def _lines(spark, sf):
    """Documents as sheets: a line is a row and its words before `|` are cells; every seventh row says download."""
    d = table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("sheet"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "t"))
    t = F.concat(F.col("t"), F.when((F.col("k") + 1) % 7 == 0, F.lit(" | Download")).otherwise(""))
    return d.select("file", "sheet", (F.col("k") + 1).alias("row_no"), F.split(t, r"\|").alias("cells"))


_LINES = r"""WITH d AS (SELECT source AS file, CAST(doc_id AS VARCHAR) AS sheet, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l0 AS (SELECT file, sheet, unnest(ls) AS t0, generate_subscripts(ls, 1) AS row_no FROM d),
l AS (SELECT file, sheet, row_no, t0 || CASE WHEN row_no % 7 = 0 THEN ' | Download' ELSE '' END AS t FROM l0), h AS (SELECT *, coalesce(list_filter(list_transform(string_split(t, '|'), lambda c: trim(c)), lambda c: c <> '')[1], '') AS head, len(string_split(t, '|')) AS width, contains(lower(t), 'download') AS down FROM l),
u AS (SELECT file, sheet, min_by(substr(head, 1, 6), row_no) AS building FROM h WHERE trim(substr(head, 1, 6)) <> '' GROUP BY 1, 2),
s AS (SELECT h.file, h.sheet, building, arg_min(row_no, struct_pack(a := length(head), b := row_no)) AS start FROM h JOIN u ON h.file = u.file AND h.sheet = u.sheet WHERE starts_with(lower(head), lower(trim(building))) GROUP BY 1, 2, 3),
e AS (SELECT s.file, s.sheet, s.building, s.start, list_sort(list(h.row_no) FILTER (h.down AND h.row_no > s.start)) AS downs, max(h.row_no) + 1 AS stop, bool_or(h.down) AS any_down FROM s JOIN h ON h.file = s.file AND h.sheet = s.sheet GROUP BY 1, 2, 3, 4),
b AS (SELECT file, sheet, building, start, coalesce(downs[2], stop) AS "end" FROM e WHERE any_down)"""


def _buildings(lines):
    head = F.substring(sheets.heading("cells"), 1, 6)
    named = lines.select("file", "sheet", "row_no", head.alias("h")).where("trim(h) <> ''")
    return named.groupBy("file", "sheet").agg(F.min_by("h", "row_no").alias("building"))


@query(f'{_LINES} SELECT sheet, start, "end" FROM b')
def block_bounds(spark, sf):
    lines = _lines(spark, sf)
    return sheets.block_bounds(lines, _buildings(lines)).select("sheet", "start", "end")


@query(f'{_LINES} SELECT b.sheet, greatest(count(h.row_no) - 1, 0) AS apparent FROM b LEFT JOIN h ON h.file = b.file AND h.sheet = b.sheet AND h.row_no > b.start AND h.row_no < b."end" AND NOT h.down AND h.width >= 3 GROUP BY b.file, b.sheet')
def apparent_rows(spark, sf):
    lines = _lines(spark, sf)
    return sheets.apparent_rows(lines, sheets.block_bounds(lines, _buildings(lines))).select("sheet", "apparent")


_TITLE = "'Units updated ' || CAST(1 + doc_id % 31 AS VARCHAR) || '/' || CAST(1 + doc_id % 13 AS VARCHAR) || '/' || CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '25' END"
_DATE = "try_strptime(CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '2025' END || '-' || lpad(CAST(1 + doc_id % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 31 AS VARCHAR), 2, '0'), '%Y-%m-%d')"


def _titled(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("sheet"), F.lit(1).alias("row_no"), F.array(F.expr(_TITLE.replace("VARCHAR", "STRING"))).alias("cells"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS sheet, CAST({_DATE} AS DATE) AS updated FROM documents WHERE {_DATE} IS NOT NULL")
def update_dates(spark, sf):
    return sheets.update_dates(_titled(spark, sf)).select("sheet", "updated")


@query(
    f"""WITH s AS (SELECT doc_id, source AS file, CAST(doc_id AS VARCHAR) AS sheet, CASE WHEN doc_id % 5 = 0 THEN 'hidden' ELSE 'visible' END AS state, CAST({_DATE} AS DATE) AS d FROM documents),
n AS (SELECT *, CASE WHEN d = max(d) OVER w AND count(*) FILTER (d IS NOT NULL) OVER w >= 1 THEN NULL ELSE max(d) OVER w END AS top FROM s WINDOW w AS (PARTITION BY file))
SELECT sheet, CASE WHEN state = 'hidden' THEN 'auto_skip' WHEN top IS NOT NULL AND d IS NOT NULL AND date_diff('day', d, top) > 120 THEN 'ambiguous' ELSE 'authoritative' END AS outcome FROM n"""
)
def classify_sheets(spark, sf):
    state = F.when(F.col("doc_id") % 5 == 0, "hidden").otherwise("visible")
    every = table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("sheet"), state.alias("sheet_state"))
    return sheets.classify_sheets(every, _titled(spark, sf)).select("sheet", "outcome")


@query("SELECT source AS source_file, CAST(sum(bad) AS DOUBLE) / count(*) AS share FROM (SELECT source, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS bad FROM documents) GROUP BY 1 HAVING CAST(sum(bad) AS DOUBLE) / count(*) > 0.5")
def garbled_files(spark, sf):
    size = F.when(F.col("doc_id") % 3 == 0, 1.0)
    rows = table(spark, sf, "documents").select(F.col("source").alias("source_file"), size.alias("size_sqft"), F.lit(None).cast("double").alias("rent_pcm"), F.lit(None).cast("double").alias("rent_psf"))
    return sheets.garbled(rows)


@query(
    """WITH u AS (SELECT o_orderkey AS unit_id, o_custkey AS page, 100 * (o_orderkey % 7) + 20.0 AS y FROM orders), k AS (SELECT page FROM u GROUP BY 1 HAVING count(*) >= 2), l AS (SELECT o_custkey AS page, 'u' || CAST(o_orderkey AS VARCHAR) AS uri, 100 * (o_orderkey % 7) + 25.0 + (o_orderkey % 3) * 4 AS y FROM orders)
SELECT u.unit_id, min(uri) AS uri FROM u JOIN k ON k.page = u.page JOIN l ON l.page = u.page AND abs(l.y - u.y) <= 12 WHERE u.unit_id <> 0 GROUP BY 1 HAVING count(*) = 1"""
)
def row_links(spark, sf):
    """Orders as units of a customer's page: one word, the order's key, shows a unit's size; each has a link some points below. A size of 0 places no unit."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("page"), (100 * (F.col("o_orderkey") % 7)).cast("double").alias("y"))
    units = o.select(F.col("k").alias("unit_id"), "page", F.lit("").alias("floor_unit"), F.col("k").cast("double").alias("size_sqft"))
    words = o.select("page", F.lit(0.0).alias("x0"), (F.col("y") + 15).alias("y0"), F.lit(9.0).alias("x1"), (F.col("y") + 25).alias("y1"), F.col("k").cast("string").alias("text"))
    shift = F.col("y") + 25 + (F.col("k") % 3) * 4
    links = o.select("page", F.concat(F.lit("u"), F.col("k").cast("string")).alias("uri"), F.lit(20.0).alias("x0"), (shift - 5).alias("y0"), F.lit(40.0).alias("x1"), (shift + 5).alias("y1"))
    return geometry.attach_links(words, links, units)


@query(
    """SELECT c_custkey AS pos, CASE WHEN c_nationkey % 4 = 0 THEN 51.5 WHEN inside THEN 51.4 END AS lat, CASE WHEN c_nationkey % 4 = 0 THEN 'given' WHEN inside THEN 'Area' END AS submarket FROM (SELECT *, c_nationkey % 3 > 0 AS inside FROM customer)"""
)
def geocode_places(spark, sf):
    """Customers as listings: some have coordinates, others are looked up among responses of which some lie outside London."""
    from ..functions.schema import KINDS, LISTING

    c = table(spark, sf, "customer")
    placed = F.col("c_nationkey") % 4 == 0
    have = {"building": F.col("c_name"), "lat": F.when(placed, 51.5), "lng": F.when(placed, -0.1), "submarket": F.when(placed, "given")}
    rows = c.select(*[have.get(k, F.lit(None)).cast(LISTING[k].dataType).alias(k) for k in KINDS], F.col("c_custkey").alias("_pos"))
    part = F.array(F.struct(F.col("c_mktsegment").alias("name"), F.array(F.lit("neighborhood")).alias("types")))
    lat = F.when(F.col("c_nationkey") % 3 > 0, 51.4).otherwise(48.0)
    responses = c.select(F.concat_ws(", ", "c_name", F.lit("London, UK")).alias("query"), F.lit("places").alias("kind"), F.lit("OK").alias("status"), lat.alias("lat"), F.lit(0.0).alias("lng"), part.alias("components"))
    # the area comes from what stands at the coordinates
    there = responses.select(F.lit("51.4,0.0").alias("query"), F.lit("reverse").alias("kind"), "status", F.lit(0.0).alias("lat"), "lng", F.array(F.struct(F.lit("Area").alias("name"), F.array(F.lit("sublocality")).alias("types"))).alias("components")).distinct()
    return geocode.geocode_rows(rows, responses.unionByName(there)).select(F.col("_pos").alias("pos"), "lat", "submarket")

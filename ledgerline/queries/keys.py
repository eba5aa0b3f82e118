"""Queries over keys, cleaning and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import links
from ..sources.documents import explode_units, strip_tags
from ..sources.mapping import headers_key
from ..plans.checkpoints import writer
from .adapter import sql_key, sql_tight, table, with_listing

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({sql_key('text')}) AS key_md5 FROM documents")
def key_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalize_key(F.col("text")).cast("binary")).alias("key_md5"))


@query(f"SELECT doc_id, md5({sql_tight('text')}) AS key_md5 FROM documents")
def tolerant_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.tolerant_text(F.col("text")).cast("binary")).alias("key_md5"))


_CODE = "' ec' || CAST(l_orderkey % 97 AS VARCHAR) || '  ' || CAST(l_linenumber AS VARCHAR) || 'a.A '"


@query(f"SELECT replace({sql_key('c')}, ' ', '') AS postcode_key, count(*) AS n FROM (SELECT {_CODE} AS c FROM lineitem) GROUP BY 1")
def postcode_key(spark, sf):
    c = F.expr(_CODE.replace("VARCHAR", "STRING"))
    return table(spark, sf, "lineitem").groupBy(t.postcode_key(c).alias("postcode_key")).agg(F.count("*").alias("n"))


_ADDRESS = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS VARCHAR) || ' ' || p_name || ' St' WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR) || 'A-' || CAST(p_size + 2 AS VARCHAR) || ' ' || p_name || ' Sq.' WHEN 3 THEN p_name || ', ' || CAST(p_size AS VARCHAR) || ' Kean Street' WHEN 4 THEN p_name || ' House - ' || CAST(p_size AS VARCHAR) || ' High Rd' ELSE CAST(p_size AS VARCHAR) || 'bis ' || p_name || ' Gdns' END"
_NUMBER = r"'^\s*(\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?)\b'"
_STREET = "CASE last WHEN 'st' THEN 'street' WHEN 'rd' THEN 'road' WHEN 'ave' THEN 'avenue' WHEN 'av' THEN 'avenue' WHEN 'sq' THEN 'square' WHEN 'ln' THEN 'lane' WHEN 'pl' THEN 'place' WHEN 'ct' THEN 'court' WHEN 'cres' THEN 'crescent' WHEN 'gdns' THEN 'gardens' WHEN 'ter' THEN 'terrace' ELSE last END"


@query(
    f"""WITH a AS (SELECT p_partkey, {_ADDRESS} AS b FROM part), s AS (SELECT *, {sql_key("regexp_replace(b, " + _NUMBER + ", '')")} AS k FROM a), w AS (SELECT *, regexp_extract(k, '([^ ]*)$', 1) AS last FROM s)
SELECT p_partkey, nullif(lower(regexp_extract(b, {_NUMBER}, 1)), '') AS house_number, regexp_replace(k, '[^ ]*$', '') || {_STREET} AS street_key,
  CASE WHEN instr(b, ', ') > 0 THEN substr(b, 1, instr(b, ', ') - 1) ELSE b END AS name_part, NOT regexp_matches(b, '[0-9]') AS digit_free FROM w"""
)
def address_keys(spark, sf):
    b = F.expr(_ADDRESS.replace("VARCHAR", "STRING"))
    return table(spark, sf, "part").select("p_partkey", t.house_number(b).alias("house_number"), t.street_key(b).alias("street_key"), t.name_part(b).alias("name_part"), t.digit_free(b).alias("digit_free"))


@query(
    f"""WITH a AS (SELECT p_partkey, {_ADDRESS} AS b FROM part), c AS (SELECT *, trim(substr(b, 1, instr(b, ', ') - 1)) AS n1, trim(substr(b, instr(b, ', ') + 2)) AS a1, trim(substr(b, 1, instr(b, ' - ') - 1)) AS n2, trim(substr(b, instr(b, ' - ') + 3)) AS a2 FROM a),
d AS (SELECT *, instr(b, ', ') > 0 AND n1 <> '' AND NOT regexp_matches(n1, '\\d') AND regexp_matches(a1, '\\d') AS c1, instr(b, ' - ') > 0 AND n2 <> '' AND NOT regexp_matches(n2, '\\d') AND regexp_matches(a2, '\\d') AS c2 FROM c)
SELECT p_partkey, CASE WHEN c1 THEN n1 WHEN c2 THEN n2 END AS name, CASE WHEN c1 THEN a1 WHEN c2 THEN a2 END AS address FROM d"""
)
def compound_split(spark, sf):
    s = t.compound_split(F.expr(_ADDRESS.replace("VARCHAR", "STRING")))
    return table(spark, sf, "part").select("p_partkey", s["name"].alias("name"), s["address"].alias("address"))


_PROVIDER = "CASE s_suppkey % 7 WHEN 0 THEN 'metspace' WHEN 1 THEN 'WORKPLACE+' WHEN 2 THEN 'Kitts' WHEN 3 THEN s_name || ' Availability' WHEN 4 THEN 'jll / hk  london availibility' WHEN 5 THEN 'Availability' ELSE s_name END"


@query(
    f"""WITH a AS (SELECT s_suppkey, {_PROVIDER} AS p FROM supplier), b AS (SELECT s_suppkey, regexp_replace(p, '^(.*[^ ])\\s+(?i:availability|availibility)$', '\\1') AS p FROM a),
c AS (SELECT *, replace({sql_key("replace(replace(p, '+', ' plus '), '&', ' and ')")}, ' ', '') AS k FROM b)
SELECT s_suppkey, CASE k WHEN 'metspace' THEN 'MetSpace' WHEN 'workplaceplus' THEN 'Workplace Plus' WHEN 'kitts' THEN 'Kitt''s' WHEN 'jllhklondon' THEN 'JLL / HK London' ELSE p END AS provider FROM c"""
)
def provider_canonical(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", t.clean_provider(F.expr(_PROVIDER.replace("VARCHAR", "STRING"))).alias("provider"))


_NOTE = "CASE p_partkey % 9 WHEN 0 THEN 'Now LET, ' || p_name WHEN 1 THEN 'high pre-let demand' WHEN 2 THEN 'Under offer: ' || p_type WHEN 3 THEN 'outlet ' || p_name WHEN 4 THEN 're-let and let' WHEN 5 THEN '100% Occupied' WHEN 6 THEN 'No longer available' WHEN 7 THEN NULL ELSE p_name || ' sublet' END"


@query(rf"SELECT p_partkey, coalesce(regexp_matches(regexp_replace(lower({_NOTE}), '(pre|re|sub)-let\b', 'x', 'g'), '\b(let|leased|no longer available|withdrawn|under offer|occupied)\b'), false) AS gone FROM part")
def let_status(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.mentions_let_status(F.expr(_NOTE.replace("VARCHAR", "STRING"))).alias("gone"))


_RAW = "CASE l_orderkey % 8 WHEN 0 THEN '1,' || CAST(100 + l_linenumber AS VARCHAR) || '.5' WHEN 1 THEN 'POA' WHEN 2 THEN ' ' || CAST(l_partkey AS VARCHAR) || ' ' WHEN 3 THEN '12d' WHEN 4 THEN 'nan' WHEN 5 THEN CAST(l_linenumber AS VARCHAR) || '.5' WHEN 6 THEN '' ELSE '-' || CAST(l_suppkey AS VARCHAR) || 'e1' END"


@query(
    rf"""WITH r AS (SELECT trim(replace({_RAW}, ',', '')) AS s FROM lineitem), v AS (SELECT CASE WHEN regexp_matches(s, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN CAST(s AS DOUBLE) + 0.0 END AS x FROM r)
SELECT x AS number, CAST(round_even(x, 0) AS BIGINT) AS whole, count(*) AS n FROM v GROUP BY 1, 2"""
)
def coerce_number(spark, sf):
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    return table(spark, sf, "lineitem").groupBy(t.coerce_number(raw, "float").alias("number"), t.coerce_number(raw, "int").alias("whole")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS size, max(CASE WHEN l_orderkey % 2 = 0 THEN 0.0 ELSE l_extendedprice END) AS pcm, max(CASE WHEN l_orderkey % 2 = 0 THEN 100 * l_tax ELSE 0.0 END) AS psf FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN size <> 0 AND pcm = 0 AND psf <> 0 THEN floor(size * psf / 12 * 100 + 0.5) / 100 ELSE pcm END AS rent_pcm, CASE WHEN size <> 0 AND psf = 0 AND pcm <> 0 THEN floor(pcm * 12 / size * 100 + 0.5) / 100 ELSE psf END AS rent_psf FROM b"""
)
def rent_derive(spark, sf):
    k = F.col("l_orderkey") % 2 == 0
    b = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("size"), F.max(F.when(k, 0.0).otherwise(F.col("l_extendedprice"))).alias("pcm"), F.max(F.when(k, 100 * F.col("l_tax")).otherwise(0.0)).alias("psf"))
    pcm, psf = t.derive_rent(F.col("size"), F.col("pcm"), F.col("psf"))
    return b.select("l_orderkey", "l_linenumber", pcm.alias("rent_pcm"), psf.alias("rent_psf"))


_ITEMS_OLD, _ITEMS_NEW = "p_name || '; Terrace with views of the ' || p_type || '; ' || p_brand", "CASE p_partkey % 4 WHEN 0 THEN p_name || '; ' || p_brand WHEN 1 THEN 'views ' || p_type || ' terrace; ' || p_name || '; ' || p_brand WHEN 2 THEN NULL ELSE p_brand || '; something else entirely' END"
_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)


def _sql_words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


def _sql_items(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({x}, '')), '[;\\n]+'), lambda w: trim(w)), lambda w: length(w) >= 3)"


@query(
    f"""WITH p AS (SELECT p_partkey, {_ITEMS_OLD} AS o, {_ITEMS_NEW} AS n FROM part), oi AS (SELECT p_partkey, unnest({_sql_items('o')}) AS x FROM p), ni AS (SELECT p_partkey, unnest({_sql_items('n')}) AS y FROM p),
s AS (SELECT p_partkey, x, {_sql_words('x')} AS xs FROM oi), u AS (SELECT p_partkey, {_sql_words('y')} AS ys FROM ni),
l AS (SELECT s.p_partkey, x, coalesce(bool_or(len(xs) > 0 AND len(ys) > 0 AND len(list_intersect(xs, ys)) / least(len(xs), len(ys)) >= 0.5), false) AS alike FROM s LEFT JOIN u ON s.p_partkey = u.p_partkey GROUP BY 1, 2)
SELECT p.p_partkey, coalesce(bool_or(NOT alike), false) AS loss, any_value(len(regexp_extract_all(coalesce(n, ''), '[^\\s]+')) / len(regexp_extract_all(o, '[^\\s]+')) < 0.5) AS poorer FROM p LEFT JOIN l ON p.p_partkey = l.p_partkey GROUP BY 1"""
)
def detail_loss(spark, sf):
    o, n = (F.expr(x) for x in (_ITEMS_OLD, _ITEMS_NEW))
    return table(spark, sf, "part").select("p_partkey", o.alias("o"), n.alias("n")).select("p_partkey", t.detail_loss(F.col("o"), F.col("n")).alias("loss"), t.richness_regression(F.col("o"), F.col("n")).alias("poorer"))


@query("SELECT o_orderkey, lat BETWEEN 51.28 AND 51.70 AND lng BETWEEN -0.51 AND 0.34 AS inside FROM (SELECT o_orderkey, 51 + (o_orderkey % 100) / 100.0 AS lat, -1 + (o_custkey % 150) / 100.0 AS lng FROM orders)")
def london_box(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", t.in_london(51 + (F.col("o_orderkey") % 100) / 100, -1 + (F.col("o_custkey") % 150) / 100).alias("inside"))


_LINK = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://www.linkedin.com/company/x' WHEN 2 THEN 'www.example.org/' WHEN 3 THEN url || '/Brochure.PDF?x=1' WHEN 4 THEN 'http://x.com/download#a' ELSE 'mailbox.com/a/floor plan' END"
_LABEL = "CASE page_id % 4 WHEN 0 THEN 'Our Brochure' WHEN 1 THEN 'Download' WHEN 2 THEN NULL ELSE 'Home' END"
_FULL = rf"CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN u ELSE 'https://' || u END"


@query(
    rf"""WITH a AS (SELECT page_id, {_LINK} AS u, lower(coalesce({_LABEL}, '')) AS l FROM pages), b AS (SELECT *, {_FULL} AS f, regexp_extract(lower(u), '^([^?#]*)', 1) AS p FROM a), c AS (SELECT *, regexp_extract(f, '^[^:/?#]+://([^/?#]*)', 1) AS h, regexp_extract(f, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS r, regexp_extract(f, '^[^:/?#]+://[^/?#]*[^?#]*\?([^#]*)', 1) AS q FROM b)
SELECT page_id, regexp_matches(h, '(^|\.)(linkedin\.com|instagram\.com|twitter\.com|x\.com|facebook\.com|rics\.org)$') OR (regexp_matches(r, '^/*$') AND q = '') AS generic,
  CASE WHEN p LIKE '%.pdf' AND (p LIKE '%brochure%' OR l LIKE '%brochure%') THEN 3 WHEN p LIKE '%.pdf' THEN 2 WHEN regexp_matches(p || ' ' || l, 'brochure|download|floorplan|floor plan') THEN 1 ELSE 0 END AS score FROM c"""
)
def link_score(spark, sf):
    u = F.expr(_LINK)
    return table(spark, sf, "pages").select("page_id", links.is_generic_link(u).alias("generic"), links.score_link(u, F.expr(_LABEL)).alias("score"))


_HOST = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query(f"SELECT page_id, CASE page_id % 4 WHEN 1 THEN {_HOST} || '/files/plan.pdf' WHEN 2 THEN {_HOST} || '/details' ELSE 'https://cdn.example.org/Brochure.pdf?v=1' END AS link, CASE page_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS score FROM pages WHERE page_id % 4 > 0")
def page_links(spark, sf):
    """Pages behind a few more anchors, so that each score occurs; their own anchors look like no brochure."""
    more = "CASE page_id % 4 WHEN 1 THEN '<a href=\"/files/plan.pdf\">Plan</a>' WHEN 2 THEN '<a href=\"/details\">Our <b>Brochure</b></a>' WHEN 3 THEN '<a href=\"https://cdn.example.org/Brochure.pdf?v=1\">x</a><a href=\"/next-brochure.pdf\">y</a>' ELSE '' END"
    return links.best_links(table(spark, sf, "pages").withColumn("html", F.concat(F.expr(more), "html")))


_MORE = "CASE page_id % 4 WHEN 1 THEN '<a href=\"/files/plan.pdf\">Plan</a>' WHEN 2 THEN '<a href=\"#top\">Brochure</a><a href=\"/details\">Our <b>Brochure</b></a>' ELSE '' END"


@query(
    f"""WITH p AS (SELECT page_id, url, page_id % 5 AS n, CASE page_id % 4 WHEN 1 THEN {_HOST} || '/files/plan.pdf' WHEN 2 THEN {_HOST} || '/details' ELSE url END AS best FROM pages)
SELECT 'https://go.example/' || page_id || '/0' AS url, CASE n WHEN 4 THEN 'https://go.example/' || page_id || '/0' WHEN 3 THEN 'https://go.example/' || page_id || '/0' ELSE best END AS link,
  CASE n WHEN 4 THEN 'circle' WHEN 3 THEN 'dead' ELSE CASE WHEN page_id % 4 IN (1, 2) THEN 'anchor' ELSE 'page' END END AS outcome, CASE n WHEN 4 THEN 20 WHEN 3 THEN 1 ELSE n + 1 END AS hops FROM p"""
)
def link_hops(spark, sf):
    """Pages behind short links of one to three hops, some of which end nowhere or run in a circle.

    Several pages may share an address; each answers at its own, told apart by a fragment, as a response is one for each url.
    """
    pages = table(spark, sf, "pages").withColumn("own", F.concat("url", F.lit("#page-"), F.col("page_id").cast("string")))
    step = lambda k: F.concat(F.lit("https://go.example/"), F.col("page_id").cast("string"), F.lit(f"/{k}"))
    n, none = F.col("page_id") % 5, F.lit(None).cast("string")
    last = {0: F.col("own"), 1: step(1), 2: step(1), 3: F.lit("/gone"), 4: step(1)}
    hop = [pages.where(n == k).select(step(0).alias("url"), F.lit(302).alias("status"), to.alias("location"), none.alias("html")) for k, to in last.items()]
    hop += [pages.where(n == k).select(step(1).alias("url"), F.lit(301).alias("status"), to.alias("location"), none.alias("html")) for k, to in ((1, F.col("own")), (2, step(2)), (4, step(0)))]
    hop.append(pages.where(n == 2).select(step(2).alias("url"), F.lit(308).alias("status"), F.col("own").alias("location"), none.alias("html")))
    responses = pages.select(F.col("own").alias("url"), F.lit(200).alias("status"), none.alias("location"), F.concat(F.expr(_MORE), "html").alias("html"))
    for h in hop:
        responses = responses.unionByName(h)
    found = links.resolve_links(pages.select(step(0).alias("url")), responses, writer(spark))
    return found.withColumn("link", F.regexp_replace("link", r"#page-\d+$", ""))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    unit = F.concat(F.lit('{"provider": "p", "units": [{"building": "b", "size_sqft": '), F.get_json_object("props", "$.k"), F.lit("}]}"))
    units = explode_units(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("file"), unit.alias("json")))
    return units.select(F.col("source_file").cast("long").alias("event_id"), F.col("size_sqft").cast("long").alias("k"))


@query("SELECT c_mktsegment, sha256(string_agg(CAST(c_nationkey AS VARCHAR), '␟' ORDER BY c_nationkey)) AS header_hash FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) GROUP BY 1")
def header_hash(spark, sf):
    d = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()
    return d.groupBy("c_mktsegment").agg(headers_key(F.transform(F.sort_array(F.collect_list("c_nationkey")), lambda x: x.cast("string"))).alias("header_hash"))


@query(rf"SELECT p_partkey, regexp_replace('See https://www.example.org/brochures/' || p_brand || '.pdf or' || chr(10) || chr(10) || 'to unsubscribe  now ' || p_name, ' +$', '') AS body FROM part")
def email_clean(spark, sf):
    from ..sources.documents import clean_email

    return table(spark, sf, "part").select("p_partkey", clean_email(F.concat(F.lit("See <https://www.example.org/brochures/"), F.col("p_brand"), F.lit(".pdf> or\n[https://img.example.org/x.png]\n\n\n\nto unsubscribe <https://www.example.org/out> now "), F.col("p_name"))).alias("body"))


@query(with_listing("SELECT pos, building || ' — ' || provider || ' — ' || floor_unit AS label FROM listing"))
def row_labels(spark, sf):
    from .adapter import listing

    return listing(spark, sf).select(F.col("_pos").alias("pos"), t.row_label(F.col("building"), F.col("provider"), F.col("floor_unit")).alias("label"))

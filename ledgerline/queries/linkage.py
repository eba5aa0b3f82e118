"""Queries over matching, diffs, conflicts and the merge itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.diff import diff_matches
from ..operators.enrich import match_units
from ..operators.match import KEYS, match_positions, suggest_similar
from ..operators.resolve import collisions, duplicate_groups, field_choices
from ..operators.stale import stale_candidates
from ..plans.checkpoints import writer
from ..plans.merge import COLUMNS, apply_merge, approval_summary
from .adapter import TOLD, kept, sides, table, with_listing

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_listing(sql)
        return f

    return add


#: What rows are matched by.
_NAMED = ["building", "provider", "floor_unit", "postcode"]


def _kept_sides(spark, sf, told=TOLD):
    """(checkpoint, batch, master); the order lines are folded and joined once, as a query reads both sides and some more than once."""
    checkpoint = writer(spark)
    return checkpoint, *sides(spark, sf, checkpoint, told)


def _found(batch, master, checkpoint=None, columns=None):
    return match_positions(batch.withColumnRenamed("_pos", "_batch_pos"), master, checkpoint is not None, checkpoint=checkpoint, columns=columns)


def _positions(spark, sf):
    _, batch, master = _kept_sides(spark, sf, _NAMED)
    return _found(batch, master)


def _diffs(found, master):
    """Diffs of the rows of match_positions that found one."""
    rows = master.select(F.col("_pos").alias("master_pos"), F.struct(*master.columns).alias("master"))
    return diff_matches(found.where("match_tier is not null").join(rows, "master_pos"), COLUMNS)


def _diffed(spark, sf):
    _, batch, master = _kept_sides(spark, sf)
    return _diffs(_found(batch, master), master)


_DIFFS = """, pairs AS (SELECT t.pos AS batch_pos, t.master_pos, m.postcode AS old_postcode, t.postcode AS new_postcode, m.size_sqft AS old_size, t.size_sqft AS new_size, m.rent_pcm AS old_rent, t.rent_pcm AS new_rent
  FROM matched t JOIN master m ON m.pos = t.master_pos),
diffs AS (SELECT batch_pos, master_pos, 'postcode' AS field, new_postcode AS new FROM pairs WHERE new_postcode IS NOT NULL AND (old_postcode IS NULL OR lower(replace(old_postcode, ' ', '')) <> lower(replace(new_postcode, ' ', '')))
  UNION ALL SELECT batch_pos, master_pos, 'size_sqft', CAST(new_size AS VARCHAR) FROM pairs WHERE abs(old_size - new_size) >= 1e-6
  UNION ALL SELECT batch_pos, master_pos, 'rent_pcm', CAST(new_rent AS VARCHAR) FROM pairs WHERE abs(old_rent - new_rent) >= 1e-6)"""


@query("SELECT coalesce(tier, 'none') AS tier, count(*) AS n FROM matched GROUP BY 1")
def match_tiers(spark, sf):
    return _positions(spark, sf).groupBy(F.coalesce("match_tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT pos AS batch_pos, master_pos, tier FROM matched WHERE tier IS NOT NULL")
def match_unique(spark, sf):
    return _positions(spark, sf).where("match_tier is not null").select(F.col("_batch_pos").alias("batch_pos"), "master_pos", F.col("match_tier").alias("tier"))


@query(None)
def match_fuzzy(spark, sf):
    checkpoint, batch, master = _kept_sides(spark, sf, _NAMED)
    near = _found(batch, master, checkpoint, ["_batch_pos", "building"]).where("match_tier = 'fuzzy_building'").select("_batch_pos", "master_pos", "building")
    old = master.select(F.col("_pos").alias("master_pos"), F.col("building").alias("master_building"))
    return near.join(old, "master_pos").select(F.col("_batch_pos").alias("batch_pos"), "master_pos", "building", "master_building")


@query(None)
def match_all_tiers(spark, sf):
    """All three tiers, as a plan runs them."""
    checkpoint, batch, master = _kept_sides(spark, sf, _NAMED)
    return _found(batch, master, checkpoint, ["_batch_pos"]).select(F.col("_batch_pos").alias("batch_pos"), "master_pos", "match_tier")


@query(None)
def suggest_near(spark, sf):
    _, batch, master = _kept_sides(spark, sf, ["building"])
    return suggest_similar(batch, master)


@query(f"{_DIFFS} SELECT batch_pos, field FROM diffs")
def field_diff(spark, sf):
    return _diffed(spark, sf).select(F.col("_batch_pos").alias("batch_pos"), F.explode("diffs").alias("d")).select("batch_pos", F.col("d.field").alias("field"))


@query(f"{_DIFFS} SELECT EXISTS (SELECT 1 FROM diffs d WHERE d.batch_pos = p.batch_pos) AS changed, count(*) AS n FROM pairs p GROUP BY 1")
def change_split(spark, sf):
    return _diffed(spark, sf).groupBy("changed").agg(F.count("*").alias("n"))


@query(
    """, m AS (SELECT *, CASE WHEN pos % 2 = 0 THEN upper(building) ELSE building END AS shown, CASE WHEN pos % 3 = 0 THEN lower(provider) ELSE provider END AS named, CASE WHEN pos % 5 = 0 THEN replace(postcode, ' ', '  ') ELSE postcode END AS code FROM batch)
SELECT pos, 'building' AS field, building AS new FROM m WHERE shown <> building UNION ALL SELECT pos, 'provider', provider FROM m WHERE named <> provider UNION ALL SELECT pos, 'postcode', postcode FROM m WHERE code <> postcode"""
)
def silent_updates(spark, sf):
    from ..operators.diff import silent_updates as silent

    batch, _ = sides(spark, sf)
    shown = {"building": F.when(F.col("_pos") % 2 == 0, F.upper("building")), "provider": F.when(F.col("_pos") % 3 == 0, F.lower("provider")), "postcode": F.when(F.col("_pos") % 5 == 0, F.replace("postcode", F.lit(" "), F.lit("  ")))}
    old = F.struct(*[F.coalesce(shown.get(c, F.col(c)), F.col(c)).alias(c) for c in COLUMNS])
    rows = batch.select("_pos", old.alias("o"), F.struct(*COLUMNS).alias("n"))
    return rows.select(F.col("_pos").alias("pos"), F.explode(silent(F.col("o"), F.col("n"))).alias("field", "new"))


@query(
    f"""{_DIFFS}, c AS (SELECT DISTINCT batch_pos, master_pos FROM diffs), g AS (SELECT master_pos, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT g.master_pos, n, (SELECT string_agg(f.field, ',' ORDER BY f.o) FROM (SELECT DISTINCT field, CASE field WHEN 'postcode' THEN 1 WHEN 'size_sqft' THEN 2 ELSE 3 END AS o FROM diffs d WHERE d.master_pos = g.master_pos) f) AS fields FROM g"""
)
def collision_groups(spark, sf):
    return collisions(_diffed(spark, sf)).select("master_pos", "n", F.array_join("fields", ",").alias("fields"))


@query(
    """, g AS (SELECT *, kb || '|' || kp AS g FROM batch), f AS (SELECT g, 'floor_unit' AS field, count(DISTINCT lower(replace(floor_unit, ' ', ''))) AS c, count(floor_unit) AS k, min_by(floor_unit, pos) AS v, min_by(floor_unit, pos) AS sole FROM g GROUP BY 1
UNION ALL SELECT g, 'postcode', count(DISTINCT lower(replace(postcode, ' ', ''))), count(postcode), arg_min_null(postcode, pos), min_by(postcode, pos) FILTER (postcode IS NOT NULL) FROM g GROUP BY 1)
SELECT g AS building_key, field, c > 1 AS needs_choice, CASE WHEN c <= 1 THEN sole END AS value, CASE WHEN k = 1 THEN sole ELSE v END AS "default" FROM f"""
)
def field_choice(spark, sf):
    from ..functions.text import normalize_key

    batch, _ = sides(spark, sf)
    rows = batch.withColumn("building_key", F.concat_ws("|", normalize_key(F.col("building")), normalize_key(F.col("provider"))))
    return field_choices(rows, "building_key", ["floor_unit", "postcode"])


@query(
    """, r AS (SELECT o_custkey % 700 AS g, o_orderkey AS pos, 100 + (o_orderkey % 4) * 4e-7 AS size_sqft, CASE WHEN o_orderkey % 9 > 0 THEN 5 + (o_orderkey % 3) * 3e-7 + CASE WHEN o_orderkey % 61 = 0 THEN 1e-5 ELSE 0 END END AS rent_pcm FROM orders),
v AS (SELECT g, pos, 'size_sqft' AS field, size_sqft AS v FROM r UNION ALL SELECT g, pos, 'rent_pcm', rent_pcm FROM r),
f AS (SELECT g, field, min_by(v, pos) FILTER (v IS NOT NULL) AS rep, arg_min_null(v, pos) AS top, count(v) AS k, count(*) AS n FROM v GROUP BY 1, 2),
c AS (SELECT f.*, (SELECT count(*) FROM v WHERE v.g = f.g AND v.field = f.field AND abs(v.v - f.rep) >= 1e-6) > 0 OR (k > 0 AND k < n) AS needs FROM f)
SELECT g, field, needs AS needs_choice, CASE WHEN NOT needs THEN rep END AS value, CASE WHEN k = 1 THEN rep ELSE top END AS "default" FROM c"""
)
def number_choice(spark, sf):
    """Close numbers, some of them blank, that agree or not."""
    k = F.col("o_orderkey")
    rent = F.when(k % 9 > 0, F.lit(5.0) + (k % 3) * F.lit(3e-7) + F.when(k % 61 == 0, F.lit(1e-5)).otherwise(0.0))
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("g"), k.alias("_pos"), (F.lit(100.0) + (k % 4) * F.lit(4e-7)).alias("size_sqft"), rent.alias("rent_pcm"))
    found = field_choices(rows, "g", ["size_sqft", "rent_pcm"], blanks_count=True)
    return found.select("g", "field", "needs_choice", F.col("value").cast("double").alias("value"), F.col("default").cast("double").alias("default"))


@query(
    """, new AS (SELECT * FROM matched WHERE tier IS NULL), e AS (SELECT pos, min(pos) OVER (PARTITION BY kb, kp, kf, coalesce(kz, ''), kz IS NULL) AS first FROM new),
s AS (SELECT pos, kp, kf, kz, regexp_replace(kb, '[^ ]*$', '') || CASE regexp_extract(kb, '([^ ]*)$', 1) WHEN 'st' THEN 'street' ELSE regexp_extract(kb, '([^ ]*)$', 1) END AS street FROM new),
ok AS (SELECT street, kp, kf, min(pos) AS first FROM s WHERE street <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT kz) <= 1),
c AS (SELECT e.pos, e.first, ok.first AS street_first FROM e JOIN s ON s.pos = e.pos LEFT JOIN ok ON ok.street = s.street AND ok.kp = s.kp AND ok.kf = s.kf),
d AS (SELECT pos, min(least(first, coalesce(street_first, first))) AS component FROM c GROUP BY 1)
SELECT pos, component FROM d WHERE component IN (SELECT component FROM d GROUP BY 1 HAVING count(*) > 1)"""
)
def dedup_components(spark, sf):
    checkpoint, batch, master = _kept_sides(spark, sf, _NAMED)
    new = _found(batch, master, columns=["_batch_pos", "building", *KEYS, "k_postcode"]).where("match_tier is null").withColumnRenamed("_batch_pos", "_pos")
    return duplicate_groups(new, checkpoint).select(F.col("_pos").alias("pos"), "component")


@query(
    """, seen AS (SELECT DISTINCT kb, kp, kf FROM batch) SELECT m.pos FROM master m WHERE m.pos NOT IN (SELECT master_pos FROM matched WHERE master_pos IS NOT NULL)
AND EXISTS (SELECT 1 FROM seen s WHERE s.kb = m.kb AND s.kp = m.kp) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.kb = m.kb AND s.kp = m.kp AND s.kf = m.kf)"""
)
def stale_rows(spark, sf):
    checkpoint, batch, master = _kept_sides(spark, sf, _NAMED)
    providers = checkpoint(master.select("provider").distinct(), "providers")
    matched = _found(batch, master).where("match_tier is not null").select(F.col("master_pos").alias("_pos"))
    return stale_candidates(batch, master, matched, snapshot=providers).select(F.col("_pos").alias("pos"))


@query(
    """, u AS (SELECT kp AS url, kb, kf, size_sqft AS s, pos AS unit_pos FROM master), p AS (SELECT b.pos, u.unit_pos, b.kf = u.kf AS f, b.size_sqft <> 0 AND u.s <> 0 AND abs(u.s - b.size_sqft) <= greatest(1.0, 0.02 * b.size_sqft) AS z FROM batch b JOIN u ON b.kp = u.url AND b.kb = u.kb),
g AS (SELECT pos, count(*) AS n, min(unit_pos) AS one, count(*) FILTER (f) AS nf, min(unit_pos) FILTER (f) AS uf, count(*) FILTER (z) AS nz, min(unit_pos) FILTER (z) AS uz FROM p GROUP BY 1)
SELECT pos, CASE WHEN n = 1 THEN one WHEN nf = 1 THEN uf WHEN nz = 1 THEN uz END AS unit_pos FROM g WHERE n = 1 OR nf = 1 OR nz = 1"""
)
def enrich_match(spark, sf):
    from ..functions.text import normalize_key

    _, batch, master = _kept_sides(spark, sf)
    units = master.select(normalize_key(F.col("provider")).alias("url"), "building", "floor_unit", "size_sqft", F.col("_pos").alias("unit_pos"))
    rows = batch.withColumn("brochure_link", normalize_key(F.col("provider")))
    return match_units(rows, units).select(F.col("_pos").alias("pos"), F.col("unit.unit_pos").alias("unit_pos"))


def _updates(diffed):
    d = diffed.where("changed")
    last = d.groupBy(F.col("master._pos").alias("_pos")).agg(F.max_by("diffs", "_batch_pos").alias("diffs"))
    return last.select("_pos", F.explode("diffs").alias("d")).select("_pos", F.col("d.field").alias("field"), F.col("d.new").alias("value"))


_LAST = f"{_DIFFS}, last AS (SELECT master_pos, max(batch_pos) AS batch_pos FROM diffs GROUP BY 1), upd AS (SELECT d.* FROM diffs d JOIN last USING (master_pos, batch_pos))"


@query(
    f"""{_LAST}, merged AS (SELECT m.pos, m.building, coalesce((SELECT new FROM upd u WHERE u.master_pos = m.pos AND u.field = 'postcode'), m.postcode) AS postcode,
  coalesce((SELECT CAST(new AS DOUBLE) FROM upd u WHERE u.master_pos = m.pos AND u.field = 'size_sqft'), m.size_sqft) AS size_sqft, coalesce((SELECT CAST(new AS DOUBLE) FROM upd u WHERE u.master_pos = m.pos AND u.field = 'rent_pcm'), m.rent_pcm) AS rent_pcm FROM master m WHERE m.pos % 11 <> 0)
SELECT pos, building, postcode, size_sqft, rent_pcm FROM merged UNION ALL SELECT (SELECT max(pos) FROM master) + 1 + pos, building, postcode, size_sqft, rent_pcm FROM matched WHERE tier IS NULL"""
)
def apply_plan(spark, sf):
    checkpoint, batch, master = _kept_sides(spark, sf)
    found = kept(_found(batch, master), checkpoint, "found")
    new = found.where("match_tier is null").select(*COLUMNS, F.col("_batch_pos").alias("_pos"))
    out = apply_merge(master, _updates(_diffs(found, master)), new, master.where("_pos % 11 = 0"))
    return out.select(F.col("_pos").alias("pos"), "building", "postcode", "size_sqft", "rent_pcm")


@query(f"{_LAST} SELECT m.building || ' — ' || m.provider || ' — ' || m.floor_unit AS property, field, count(*) AS n FROM upd JOIN master m ON m.pos = upd.master_pos GROUP BY 1, 2")
def approval_rows(spark, sf):
    _, batch, master = _kept_sides(spark, sf)
    return approval_summary(master, _updates(_diffs(_found(batch, master), master))).groupBy("property", "field").agg(F.count("*").alias("n"))



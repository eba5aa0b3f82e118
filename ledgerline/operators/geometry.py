"""Attaching a page's links to the units listed on it, by the height of their rows.

words (page, x0, y0, x1, y1, text), links (page, uri, x0, y0, x1, y1), units (unit_id, page, floor_unit, size_sqft).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of a floor's name that do not tell floors apart.
FLOOR_STOPWORDS = ["floor", "floors", "suite", "unit", "office", "level", "the", "of", "and"]
CAPTION_HEIGHT = 20.0
ROW_TOLERANCE = 12.0
LEAST_UNITS = LEAST_LINKS = 2


def _tokens(c):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)


def upper_median(name: str):
    """The upper of the two middle values of a column, or the middle one."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def caption_links(links: DataFrame) -> DataFrame:
    """Links with a target and of a caption's height, with their vertical centre y."""
    return links.where((F.col("uri") != "") & (F.col("y1") - F.col("y0") <= CAPTION_HEIGHT)).withColumn("y", (F.col("y0") + F.col("y1")) / 2)


def row_heights(words: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, page, y): where a unit's row stands.

    It is at the one word that shows the unit's size; else at the upper median of the words whose first
    token is one of its floor's.
    """
    w = words.select("page", "text", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    whole = F.when(F.col("size_sqft") == F.floor("size_sqft"), F.col("size_sqft").cast("long").cast("string")).otherwise(F.col("size_sqft").cast("string"))
    sized = units.where("size_sqft <> 0").select("unit_id", "page", whole.alias("k")).join(w.select("page", "y", F.regexp_replace("text", r"[^\d.]", "").alias("k")), ["page", "k"])
    by_size = sized.groupBy("unit_id", "page").agg(F.count("*").alias("n"), F.first("y").alias("y")).where("n = 1").select("unit_id", "page", "y")
    names = units.select("unit_id", "page", F.explode(F.array_except(_tokens(F.col("floor_unit")), F.array(*map(F.lit, FLOOR_STOPWORDS)))).alias("k"))
    named = names.join(w.select("page", "y", F.get(_tokens(F.col("text")), 0).alias("k")), ["page", "k"])
    by_name = named.groupBy("unit_id", "page").agg(upper_median("y").alias("y"))
    return by_size.unionByName(by_name.join(by_size, ["unit_id", "page"], "left_anti"))


def column_ranges(words: DataFrame) -> DataFrame:
    """(page, kind, lo, hi): the brochure column of a page, or its floor plan column where there is none."""
    w = words.withColumn("t", F.lower(F.regexp_replace("text", r"^[.,:;]+|[.,:;]+$", "")))
    top = lambda df: df.groupBy("page").agg(F.min_by(F.struct("x0", "x1"), "y0").alias("h")).select("page", (F.col("h.x0") - 40).alias("lo"), (F.col("h.x1") + 10).alias("hi"))
    brochure = top(w.where("t = 'brochure'")).withColumn("kind", F.lit("brochure"))
    single = top(w.where("t = 'floorplan'"))
    f = w.where("t = 'floor'").select("page", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y0").alias("fy"), ((F.col("y0") + F.col("y1")) / 2).alias("fm"))
    p = w.where("t = 'plan'").select("page", F.col("x0").alias("c"), F.col("x1").alias("d"), ((F.col("y0") + F.col("y1")) / 2).alias("pm"))
    pairs = f.join(p, "page").where("abs(fm - pm) < 4 and c - b >= 0 and c - b < 20")
    double = pairs.groupBy("page").agg(F.min_by(F.struct("a", "d"), "fy").alias("h")).select("page", (F.col("h.a") - 40).alias("lo"), (F.col("h.d") + 10).alias("hi"))
    plan = single.unionByName(double.join(single, "page", "left_anti")).withColumn("kind", F.lit("floor plan"))
    return brochure.unionByName(plan.join(brochure, "page", "left_anti"))


def attach_links(words: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, uri): the one caption link level with a unit's row, in the brochure column or outside the floor plan's.

    Pages need two units and two such links. The band join is an equi-join on bands of ROW_TOLERANCE.
    """
    near = caption_links(links)
    pages = units.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_UNITS).select("page").join(near.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LINKS).select("page"), "page")
    rows = row_heights(words, units).join(pages, "page", "left_semi").withColumnRenamed("y", "row_y")
    band = lambda y: F.floor(y / ROW_TOLERANCE)
    spots = rows.withColumn("band", F.explode(F.array(band(F.col("row_y")) - 1, band(F.col("row_y")), band(F.col("row_y")) + 1)))
    level = spots.join(near.withColumn("band", band(F.col("y"))), ["page", "band"]).where(F.abs(F.col("y") - F.col("row_y")) <= ROW_TOLERANCE)
    inside = F.col("x0").between(F.col("lo"), F.col("hi")) | F.col("x1").between(F.col("lo"), F.col("hi"))
    ok = F.when(F.col("kind") == "brochure", inside).when(F.col("kind") == "floor plan", ~inside).otherwise(F.lit(True))
    kept = level.join(column_ranges(words), "page", "left").where(ok)
    return kept.groupBy("unit_id").agg(F.count("*").alias("n"), F.first("uri").alias("uri")).where("n = 1").select("unit_id", "uri")


def caption_texts(words: DataFrame, links: DataFrame, pad: float = 2.0) -> DataFrame:
    """links with caption: the words that a link's box, `pad` points larger, overlaps, in reading order; for logs."""
    w = words.select("page", F.col("x0").alias("wx0"), F.col("y0").alias("wy0"), F.col("x1").alias("wx1"), F.col("y1").alias("wy1"), "text")
    over = (F.col("wx0") < F.col("x1") + pad) & (F.col("wx1") > F.col("x0") - pad) & (F.col("wy0") < F.col("y1") + pad) & (F.col("wy1") > F.col("y0") - pad)
    hits = links.distinct().join(w, "page").where(over).groupBy(*links.columns).agg(F.sort_array(F.collect_list(F.struct("wy0", "wx0", "text"))).alias("_t"))
    return links.join(hits, links.columns, "left").select(*links.columns, F.coalesce(F.array_join(F.transform("_t", lambda x: x["text"]), " "), F.lit("")).alias("caption"))

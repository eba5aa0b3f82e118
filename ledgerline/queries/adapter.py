"""The driver's tables read as listings, in Spark and as the same SQL text, and SQL of the key functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import KINDS, LISTING

CUT = "1996-01-01"
#: What the tables tell of a listing; its other columns are null.
TOLD = ["building", "provider", "floor_unit", "postcode", "size_sqft", "rent_pcm"]
WS = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"

#: One listing for each order line; columns that the tables do not have are left out.
LISTING_SQL = f"""
lines AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS partkey, max(l_suppkey) AS suppkey, max(l_quantity) AS q, max(l_extendedprice) AS price, max(l_shipdate) AS shipped
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
listing AS (SELECT l_orderkey * 10 + l_linenumber AS pos, p_name || CASE WHEN l_orderkey % 2 = 0 THEN ' ' || CAST(p_partkey AS VARCHAR) ELSE '' END AS building, s_name AS provider,
  'Floor ' || CAST(l_linenumber AS VARCHAR) AS floor_unit,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'EC' || CAST(l_orderkey % 9 AS VARCHAR) || ' ' || CAST(l_linenumber AS VARCHAR) || 'AA' END AS postcode,
  q AS size_sqft, price AS rent_pcm, shipped >= TIMESTAMP '{CUT} 00:00:00' AS is_batch
  FROM lines JOIN part ON partkey = p_partkey JOIN supplier ON suppkey = s_suppkey),
keyed AS (SELECT *, {{kb}} AS kb, {{kp}} AS kp, {{kf}} AS kf, CASE WHEN postcode IS NOT NULL THEN {{kz}} END AS kz FROM listing),
master AS (SELECT * FROM keyed WHERE NOT is_batch), batch AS (SELECT * FROM keyed WHERE is_batch),
m1 AS (SELECT kb, kp, kf, kz, min(pos) AS pos FROM master WHERE kz IS NOT NULL GROUP BY kb, kp, kf, kz HAVING count(*) = 1),
m2 AS (SELECT kb, kp, kf, min(pos) AS pos FROM master GROUP BY kb, kp, kf HAVING count(*) = 1),
matched AS (SELECT b.*, CASE WHEN m1.pos IS NOT NULL THEN 'postcode' WHEN m2.pos IS NOT NULL THEN 'fallback' END AS tier, coalesce(m1.pos, m2.pos) AS master_pos
  FROM batch b LEFT JOIN m1 ON b.kb = m1.kb AND b.kp = m1.kp AND b.kf = m1.kf AND b.kz = m1.kz LEFT JOIN m2 ON b.kb = m2.kb AND b.kp = m2.kp AND b.kf = m2.kf)
"""


def sql_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g'), '[{WS}]+', ' ', 'g'))"


def sql_tight(x: str) -> str:
    """Text without white space, lower case."""
    return f"regexp_replace(lower(coalesce({x}, '')), '[{WS}]+', '', 'g')"


def with_listing(select: str) -> str:
    body = LISTING_SQL.format(kb=sql_key("building"), kp=sql_key("provider"), kf=sql_key("floor_unit"), kz=f"replace({sql_key('postcode')}, ' ', '')")
    return f"WITH {body} {select}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LISTING_SQL's rows under the listing's schema, with _pos and is_batch."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(a) for c, a in (("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey"), ("l_quantity", "q"), ("l_extendedprice", "price"), ("l_shipdate", "shipped"))])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = line.join(part, "p_partkey").join(supplier, "s_suppkey")
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    have = {
        "building": F.concat(F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).otherwise("")),
        "provider": F.col("s_name"),
        "floor_unit": F.concat(F.lit("Floor "), n),
        "postcode": F.when(k % 3 != 0, F.concat(F.lit("EC"), (k % 9).cast("string"), F.lit(" "), n, F.lit("AA"))),
        "size_sqft": F.col("q"),
        "rent_pcm": F.col("price"),
    }
    told = [have[c].alias(c) for c in TOLD]
    return _whole(j.select(*told, (k * 10 + F.col("l_linenumber")).cast("long").alias("_pos"), (F.col("shipped") >= F.lit(f"{CUT} 00:00:00").cast("timestamp")).alias("is_batch")))


def _whole(rows: DataFrame) -> DataFrame:
    """rows with the listing's columns that they lack, as nulls."""
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(LISTING[c].dataType).alias(c) for c in KINDS]
    return rows.select(*cols, *[c for c in rows.columns if c not in KINDS])


def kept(rows: DataFrame, checkpoint, name: str, told: list[str] = TOLD) -> DataFrame:
    """rows written once and reread; of the listing's columns only told are written, so no later shuffle carries the others, which are null."""
    return _whole(checkpoint(rows.drop(*[c for c in KINDS if c not in told]), name))


def sides(spark: SparkSession, sf_dir: str, checkpoint=None, told: list[str] = TOLD) -> tuple[DataFrame, DataFrame]:
    """(batch, master); with checkpoint(df, name) the order lines are folded and joined once for all that read them, and only columns in told are kept."""
    rows = listing(spark, sf_dir)
    rows = kept(rows, checkpoint, "listing", told) if checkpoint else rows
    return rows.where("is_batch").drop("is_batch"), rows.where("not is_batch").drop("is_batch")

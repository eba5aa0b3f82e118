"""Listings from CSV files, email bodies and extracted JSON."""

from __future__ import annotations

from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.schema import KINDS, LISTING
from ..functions.text import derive_rent
from ..operators.links import finalize_link, resolve_email_links

UNIT = "building string, submarket string, address_1 string, postcode string, floor_unit string, size_sqft double, desks_min long, desks_max long, rent_pcm double, rent_psf double, special_features string, state_of_space string, brochure_link string, page_index int"
EXTRACTION = f"provider string, contacts string, fully_occupied_buildings array<string>, units array<struct<{', '.join(x.replace(' ', ':', 1) for x in UNIT.split(', '))}>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file under its own headers, all text; types come with the mapping."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def strip_tags(html):
    """Text with every tag turned into a space."""
    return F.regexp_replace(html, "<[^>]+>", " ")


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("text", StringType())]))
def _body(raw: pd.Series) -> pd.DataFrame:

    def body(data):
        parts = list(message_from_bytes(data, policy=policy.default).walk())
        for kind in ("text/plain", "text/html"):
            for p in parts:
                if p.get_content_type() == kind:
                    try:
                        text = p.get_content()
                    except (LookupError, UnicodeError):  # an unknown or wrong charset
                        text = (p.get_payload(decode=True) or b"").decode("utf-8", "replace")
                    return kind, text
        return None, None

    return pd.DataFrame([body(data) for data in raw], columns=["kind", "text"])


def email_body(raw):
    """The first plain part of a message, else the first HTML part without tags, else null."""
    part = _body(raw)
    return F.when(part["kind"] == "text/plain", part["text"]).otherwise(strip_tags(part["text"]))


def inherit_building(units: DataFrame, file: str = "file", pos: str = "_pos") -> DataFrame:
    """units whose blank building takes the last one above it in its file; those before the first building go."""
    above = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("building", F.last(F.when(F.col("building") != "", F.col("building")), ignorenulls=True).over(above)).where("building is not null")


def clean_email(text):
    """Without administrative and generic links, lines that are a bracketed link alone, and runs of blank lines."""
    lines = F.filter(F.split(resolve_email_links(text), "\r?\n"), lambda x: ~x.rlike(r"^\s*\[https?://[^\]]*\]\s*$"))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def read_emails(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of the .eml files under a path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    text = raw.select(F.col("path").alias("file"), email_body("content").alias("body"))
    return text.select("file", clean_email(F.col("body")).alias("body"))


def explode_units(extractions: DataFrame, is_pdf: bool = False) -> DataFrame:
    """Listing rows and _pos of extractions (file, json[, fallback_link]): one for each unit.

    A blank building takes the last one above it in its file; units before the first building go. The
    provider and contacts are the file's, the reference is the provider, and a missing rent follows
    from the size and the other one.
    """
    fallback = F.col("fallback_link") if "fallback_link" in extractions.columns else F.lit(None).cast("string")
    e = extractions.select("file", fallback.alias("fallback"), F.from_json("json", EXTRACTION).alias("j"))
    u = e.select("file", "fallback", F.col("j.provider").alias("provider"), F.col("j.contacts").alias("contacts"), F.posexplode("j.units").alias("_pos", "u")).select("file", "fallback", "provider", "contacts", F.col("_pos").cast("long").alias("_pos"), "u.*")
    u = inherit_building(u)
    pcm, psf = derive_rent(F.col("size_sqft"), F.col("rent_pcm"), F.col("rent_psf"))
    u = u.withColumns({"rent_pcm": pcm, "rent_psf": psf, "brochure_link": finalize_link(F.col("brochure_link"), F.col("brochure_link"), F.lit(is_pdf), F.col("fallback")), "internal_ref": F.col("provider"), "source_file": F.col("file")})
    return u.select(*[(F.col(c) if c in u.columns else F.lit(None)).cast(LISTING[c].dataType).alias(c) for c in KINDS], "_pos")


def fully_occupied(extractions: DataFrame) -> DataFrame:
    """(file, provider, building) that extractions call fully occupied."""
    j = extractions.select("file", F.from_json("json", EXTRACTION).alias("j"))
    return j.select("file", F.col("j.provider").alias("provider"), F.explode("j.fully_occupied_buildings").alias("building")).where("trim(building) <> ''")


def content_hash(content, logic: str, decisions=None):
    """sha256 of the logic's version, a file's bytes and the sorted decisions about it."""
    parts = [F.encode(F.lit(logic), "UTF-8"), F.unhex(F.lit("00")), content, F.unhex(F.lit("00")), F.encode(decisions if decisions is not None else F.lit("{}"), "UTF-8")]
    return F.sha2(F.concat(*parts), 256)

"""The listing record: its columns in written order, their kinds, and which of them a diff compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The columns of a listing, in order, with their kinds.
KINDS = {
    "internal_ref": "str",
    "provider": "str",
    "address_1": "str",
    "postcode": "str",
    "source_file": "str",
    "property_id": "str",
    "lat": "float",
    "lng": "float",
    "submarket": "str",
    "building": "str",
    "floor_unit": "str",
    "size_sqft": "float",
    "desks_min": "int",
    "desks_max": "int",
    "rent_pcm": "float",
    "rent_psf": "float",
    "brochure_link": "str",
    "special_features": "str",
    "state_of_space": "str",
    "contacts": "str",
}
_TYPES = {"str": StringType(), "float": DoubleType(), "int": LongType()}
LISTING = StructType([StructField(name, _TYPES[kind], name != "building") for name, kind in KINDS.items()])
DIFF_FIELDS = [name for name in KINDS if name not in ("source_file", "property_id")]
LINEAGE_FIELDS = ("source_file", "property_id")


def title_label(field: str) -> str:
    """internal_ref -> Internal Ref."""
    return " ".join(w.capitalize() for w in field.split("_"))


def label_field(label: str) -> str:
    """Internal Ref -> internal_ref."""
    return label.strip().lower().replace(" ", "_")


def to_listing(df: DataFrame) -> DataFrame:
    """df projected on the listing by column name: missing columns are null, unknown ones go, numbers are cast.

    Other columns that start with `_`, such as positions, are kept behind.
    """
    names = {label_field(c): c for c in reversed(df.columns)}
    cols = [(F.col(f"`{names[n]}`").try_cast(_TYPES[k]) if n in names else F.lit(None).cast(_TYPES[k])).alias(n) for n, k in KINDS.items()]
    return df.select(*cols, *[c for c in df.columns if c.startswith("_")])


def is_blank(c: Column, kind: str = "str") -> Column:
    """Null, NaN, or text of white space alone."""
    if kind == "str":
        return c.isNull() | ~c.rlike(r"[^\t-\r\x1c-\x1f\x85\p{Z}]")
    return c.isNull() | (F.isnan(c) if kind == "float" else F.lit(False))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for a row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over as many tasks as a shuffle has, where a file of few bytes would be the work of one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

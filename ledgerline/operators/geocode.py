"""Coordinates and addresses of listings from tables of geocoder responses; nothing is fetched.

responses: (query, kind, status, lat, lng, components array<struct<name, types>>) with kind geocode, places or reverse.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import is_blank
from ..functions.text import compound_split, in_london


def component(components: Column, *kinds: str) -> Column:
    """Name of the first component of one of these types."""
    return F.get(F.filter(components, lambda c: F.arrays_overlap(c["types"], F.array(*map(F.lit, kinds)))), 0)["name"]


def address_line(components: Column) -> Column:
    line = F.concat_ws(" ", component(components, "street_number"), component(components, "route"))
    return F.nullif(line, F.lit(""))


def submarket(components: Column) -> Column:
    return component(components, "sublocality", "sublocality_level_1", "neighborhood")


#: Metres within which an answer at other coordinates counts, metres of a degree, and the latitude of the plane.
NEAR, DEGREE, LATITUDE = 25.0, 111_320.0, 51.5
# Our own wordings of what may fail.
NO_ADDRESS = "coordinates found, but no street address or postcode there"
OUTSIDE = "the place found lies outside London"
NO_MATCH = "neither address nor place found"


def address_query() -> Column:
    """What a row with an address and a postcode is asked by."""
    return F.when(~is_blank(F.col("address_1")) & ~is_blank(F.col("postcode")), F.concat_ws(", ", "address_1", "postcode", F.lit("UK")))


def place_query(place: Column) -> Column:
    """What a place is asked by, with the row's submarket if it has one; null without a place."""
    return F.when(~is_blank(place), F.concat_ws(", ", place, F.when(~is_blank(F.col("submarket")), F.col("submarket")), F.lit("London, UK")))


def spot_query(lat: Column, lng: Column) -> Column:
    """What coordinates are asked by."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat_ws(",", lat.cast("string"), lng.cast("string")))


def nearest(spots: DataFrame, answers: DataFrame, key: str, within: float = NEAR, checkpoint=None) -> DataFrame:
    """spots (lat, lng) with the nearest of answers (lat, lng, key, ...), a struct `answer`, at most `within` metres away;
    of those equally far, to a thousandth of a millimetre, the one with the least key.

    Both are put on a grid, and an answer stands in its cell and the eight around it, so they meet by cell. Spots without one
    go. Each pair of coordinates is asked once and answers at the same ones are one, that with the least key. Metres are
    those of a plane at London's latitude. With checkpoint(df, name), which keeps what each grid finds, cells grow from
    within / 64 to `within` by four: what is no farther than a cell is wide is the nearest, and only spots without that are asked
    on the next grid, so dense answers make few pairs. Without it there is the last grid alone.
    """
    x, y = F.col("lng") * (DEGREE * math.cos(math.radians(LATITUDE))), F.col("lat") * DEGREE
    placed = lambda t: t.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").withColumns({"_x": x, "_y": y})
    there = answers.groupBy("lat", "lng").agg(F.min_by(F.struct(*answers.columns), key).alias("answer"))
    there = placed(there).select("answer", F.col("_x").alias("_ax"), F.col("_y").alias("_ay"))
    rest = placed(spots.select("lat", "lng").distinct())
    keep, widths = (checkpoint, [within / 64, within / 16, within / 4, within]) if checkpoint else (lambda df, name: df, [within])
    there, rest = keep(there, "answers"), keep(rest, "spots")
    apart = F.round(F.sqrt((F.col("_x") - F.col("_ax")) ** 2 + (F.col("_y") - F.col("_ay")) ** 2), 6)
    found = []
    for width in widths:
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))  # noqa: B023, E731
        near = there.select("*", around("_ax").alias("_cx")).withColumn("_cy", around("_ay"))
        sure = within if width == within else 0.99 * width  # not at the very edge, where answers that count as equally far may be outside
        pairs = rest.withColumns({"_cx": cell("_x"), "_cy": cell("_y")}).join(near, ["_cx", "_cy"]).withColumn("_far", apart).where(F.col("_far") <= sure)
        found.append(keep(pairs.groupBy("lat", "lng").agg(F.min_by("answer", F.struct("_far", f"answer.{key}")).alias("answer")), "nearest"))
        rest = rest.join(found[-1], ["lat", "lng"], "left_anti")
    return reduce(DataFrame.unionByName, found)


def geocode_rows(rows: DataFrame, responses: DataFrame, within: float = NEAR, checkpoint=None) -> DataFrame:
    """rows with coordinates, address, postcode and submarket filled where they are blank, and failure.

    A row with coordinates, or one whose address and postcode are found, only gets a submarket, from
    what stands at those coordinates: the nearest answer, at most `within` metres away. Others are asked
    by place: the address part of a compound building first, then the whole building; an answer counts if it is OK and lies in London. Its own
    components fill the address and postcode, and what stands at its coordinates fills what is still
    blank. What is there is never overwritten. failure tells apart a place without an address, a place
    outside London, and nothing found; of several responses to one query the least counts.
    """

    def ask(df, kind, query, name):
        told = responses.where((F.col("kind") == kind) & (F.col("status") == "OK")).groupBy(F.col("query").alias(f"{name}_q")).agg(F.min(F.struct("lat", "lng", "components")).alias(name))
        return df.withColumn(f"{name}_q", query).join(told, f"{name}_q", "left").drop(f"{name}_q")

    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    out = ask(rows.withColumn("_placed", placed), "geocode", F.when(~placed, address_query()), "_address")
    open_ = ~F.col("_placed") & F.col("_address.lat").isNull()
    out = ask(out, "places", F.when(open_, place_query(compound_split(F.col("building"))["address"])), "_part")
    out = ask(out, "places", F.when(open_, place_query(F.col("building"))), "_whole")
    inside = lambda c: in_london(F.col(f"{c}.lat"), F.col(f"{c}.lng"))
    out = out.withColumn("_place", F.when(inside("_part"), F.col("_part")).when(inside("_whole"), F.col("_whole")))
    fill = lambda c, v: F.when(is_blank(F.col(c)), v).otherwise(F.col(c))
    out = out.withColumns({"lat": F.when(F.col("_placed"), F.col("lat")).otherwise(F.coalesce("_address.lat", "_place.lat", "lat")), "lng": F.when(F.col("_placed"), F.col("lng")).otherwise(F.coalesce("_address.lng", "_place.lng", "lng"))})
    out = out.withColumns({"address_1": fill("address_1", address_line(F.col("_place.components"))), "postcode": fill("postcode", component(F.col("_place.components"), "postal_code"))})
    short = is_blank(F.col("address_1")) | is_blank(F.col("postcode"))
    found = F.col("_placed") | F.col("_address.lat").isNotNull() | F.col("_place").isNotNull()
    again = found & (is_blank(F.col("submarket")) | (F.col("_place").isNotNull() & short))
    told = responses.where("kind = 'reverse' and status = 'OK'").select("query", "components")
    told = told.select("query", "components", *[F.get(F.split("query", ","), k).try_cast("double").alias(c) for k, c in enumerate(("lat", "lng"))])
    spots = nearest(out.where(again).select("lat", "lng"), told, "query", within, checkpoint).select("lat", "lng", F.col("answer.components").alias("_there"))
    out = out.withColumn("_again", again).join(spots, ["lat", "lng"], "left")
    there = F.when(F.col("_again"), F.col("_there"))
    by_place = lambda v: F.when(F.col("_place").isNotNull(), v)
    out = out.withColumns({"address_1": fill("address_1", by_place(address_line(there))), "postcode": fill("postcode", by_place(component(there, "postal_code"))), "submarket": fill("submarket", submarket(there))})
    outside = F.col("_whole").isNotNull() & ~F.coalesce(inside("_whole"), F.lit(False))
    failure = F.when(F.col("_place").isNotNull() & short, NO_ADDRESS).when(~found & outside, OUTSIDE).when(~found, NO_MATCH)
    return out.select(*rows.columns, failure.alias("failure"))

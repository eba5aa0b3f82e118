"""Nearest answers against all pairs, and reverse look-ups that need not hit a coordinate exactly."""

import math
import random

from ledgerline.operators import geocode

from .test_merge import row, rows


def test_against_all_pairs(spark):
    r = random.Random(2)
    near = lambda: (51.5 + r.randrange(60) * 1e-4 * r.choice([1, 0.37]), -0.1 - r.randrange(60) * 1e-4 * r.choice([1, 0.61]))
    spots = [near() for _ in range(300)] + [(None, 1.0), (float("nan"), 0.0), (-51.5, 0.0), (51.5, -0.1)]
    answers = [(*near(), f"k{r.randrange(1000)}", i) for i in range(400)] + [(None, None, "a", 0), (51.5, -0.1, "b", 1), (51.5, -0.1, "a", 2)]
    made = spark.createDataFrame(answers, "lat double, lng double, key string, n int")
    for within in (25.0, 60.0, 400.0):
        got = {(x.lat, x.lng): x.answer.key for x in geocode.nearest(spark.createDataFrame(spots + spots[:9], "lat double, lng double"), made, "key", within).collect()}
        scale = geocode.DEGREE * math.cos(math.radians(geocode.LATITUDE))
        want = {}
        for lat, lng in spots:
            if lat is not None and lng is not None and lat == lat:
                far = [(math.hypot(lng * scale - b * scale, (lat - a) * geocode.DEGREE), k) for a, b, k, _ in answers if a is not None]
                if (best := min((round(d, 6), k) for d, k in far))[0] <= within:
                    want[lat, lng] = best[1]
        assert got == want
    assert geocode.nearest(made.limit(0).select("lat", "lng"), made, "key").count() == 0


def test_reverse_by_distance(spark):
    part = "array<struct<name:string,types:array<string>>>"
    there = lambda name: [(name, ["sublocality"])]
    responses = spark.createDataFrame([("51.50001,-0.1", "reverse", "OK", None, None, there("Near")), ("51.5001,-0.1", "reverse", "OK", None, None, there("Far")), ("51.6,-0.1", "reverse", "ZERO", None, None, there("No")), ("x", "reverse", "OK", None, None, there("Odd"))], f"query string, kind string, status string, lat double, lng double, components {part}")
    made = rows(spark, row("A", lat=51.5, lng=-0.1), row("B", lat=51.5, lng=-0.1, submarket="Own"), row("C", lat=51.6, lng=-0.1), row("D"), row("E", lat=51.50009, lng=-0.1))
    got = {r.building: r.submarket for r in geocode.geocode_rows(made, responses).collect()}
    assert got == {"A": "Near", "B": "Own", "C": None, "D": None, "E": "Far"}

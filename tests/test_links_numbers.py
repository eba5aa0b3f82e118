"""Links over several hops and numbers that are nearly equal, against plain loops."""

import json
import random
from urllib.parse import quote


from ledgerline.operators.links import resolve_links
from ledgerline.operators.resolve import field_choices
from ledgerline.plans.checkpoints import writer

from .test_merge import row, rows


def wrapped(target):
    return "https://public.dynamics.com/t?msdynmkt_target=" + quote(json.dumps({"TargetUrl": quote(target, safe="")}), safe="")


def test_links_over_hops(spark):
    answers = [
        ("https://a.example/", 200, None, '<a href="#b">Brochure</a><a href="p/Brochure.pdf">x</a><a href="q.pdf">y</a>'),
        ("https://b.example/x", 302, "/y", None), ("https://b.example/y", 301, "//c.example/z?q=1", None), ("https://c.example/z?q=1", 200, None, "<p>nothing</p>"),
        ("https://d.example/1", 302, "https://d.example/2", None), ("https://d.example/2", 302, "https://d.example/1", None),
        ("https://e.example/", 302, "https://e.example/missing", None), ("https://f.example/", 500, None, '<a href="x.pdf">x</a>'),
        ("https://g.example/", 302, None, None), ("https://h.example/", 302, "https://h.example/doc.pdf", None), ("https://h.example/doc.pdf", 200, None, None),
        ("https://i.example/", 200, None, '<a href="/details">Our <b>brochure</b></a><a href="/floor plan">z</a>'),
        *[(f"https://long.example/{k}", 302, str(k + 1), None) for k in range(25)], ("https://long.example/25", 200, None, ""),
    ]
    responses = spark.createDataFrame([*answers, *answers[:3]], "url string, status int, location string, html string")
    want = {
        "a.example/": ("https://a.example/p/Brochure.pdf", "anchor", 0), "https://b.example/x": ("https://c.example/z?q=1", "page", 2),
        "https://d.example/1": ("https://d.example/1", "circle", 20), "https://e.example/": ("https://e.example/", "dead", 1), "https://f.example/": ("https://f.example/", "dead", 0),
        "https://g.example/": ("https://g.example/", "dead", 0), "https://h.example/": ("https://h.example/doc.pdf", "page", 1), "https://i.example/": ("https://i.example/details", "anchor", 0),
        "z.example/A.PDF?x#y": ("https://z.example/A.PDF?x#y", "document", 0), "https://nowhere.example": ("https://nowhere.example", "dead", 0),
        wrapped("https://i.example/"): ("https://i.example/details", "anchor", 0), wrapped("mailto:a@b.example"): (wrapped("mailto:a@b.example"), "mail", 0),
        wrapped(wrapped("https://b.example/x")): ("https://c.example/z?q=1", "page", 2), wrapped("https://gone.example/x"): ("https://gone.example/x", "dead", 0),
        "https://long.example/5": ("https://long.example/25", "page", 20), "https://long.example/4": ("https://long.example/4", "circle", 20),
    }
    links = spark.createDataFrame([(u,) for u in [*want, *list(want)[:4], None]], "url string")
    assert {r.url: (r.link, r.outcome, r.hops) for r in resolve_links(links, responses, writer(spark)).collect()} == want
    assert resolve_links(links.limit(0), responses, writer(spark)).count() == 0


def greedy(values, blanks_count):
    """Classes by their first members, in order."""
    classes, blanks = [], False
    for v in values:
        if v is None or v != v:
            blanks = True
        elif not any(abs(v - c) < 1e-6 for c in classes):
            classes.append(v)
    several = len(classes) > 1 or (blanks_count and blanks and bool(classes))
    some = [v for v in values if v is not None and v == v]
    return several, classes[0] if classes and not several else None, some[0] if len(some) == 1 else values[0]


def test_close_numbers(spark):
    r = random.Random(3)
    groups = [[1.0000004, 1.0000006], [1.0, 1.000001], [0.9999995, 1.0, 1.0000005], [1.0, 0.9999995, 1.0000005], [float("inf")], [float("inf"), float("inf")], [None, None], [None, 2.0], [float("nan"), 3.0, 3.0000009]]
    groups += [[None if r.random() < 0.1 else 50.0 + r.choice([0, 3e-7, 6e-7, 9e-7, 1.2e-6, -4e-7]) * r.choice([0, 1, 1]) for _ in range(r.randrange(1, 6))] for _ in range(300)]
    made = [row(f"G{g}", size_sqft=v) for g, vs in enumerate(groups) for v in vs]
    for blanks_count in (False, True):
        got = {x.building: (x.needs_choice, x.value and float(x.value), x.default and float(x.default)) for x in field_choices(rows(spark, *made), "building", ["size_sqft"], blanks_count=blanks_count).collect()}
        same = lambda v: "nan" if v is not None and v != v else v
        want = {f"G{g}": tuple(map(same, greedy(vs, blanks_count))) for g, vs in enumerate(groups)}
        assert {k: tuple(map(same, v)) for k, v in got.items()} == want


def test_whole_numbers_and_texts(spark):
    made = [row("A", desks_min=4, contacts="x Y"), row("A", desks_min=4, contacts="XY"), row("B", desks_min=4), row("B", desks_min=5)]
    got = {(x.building, x.field): x.needs_choice for x in field_choices(rows(spark, *made), "building", ["desks_min", "contacts"]).collect()}
    assert got == {("A", "desks_min"): False, ("A", "contacts"): False, ("B", "desks_min"): True, ("B", "contacts"): False}

"""Scalar rules against literal cases."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as t
from ledgerline.operators import links
from ledgerline.operators.sheets import splice_house_number


def run(spark, f, *values, kinds=None):
    names = [f"c{i}" for i in range(len(values[0]))]
    schema = ", ".join(f"{n} {(kinds or ['string'] * len(names))[i]}" for i, n in enumerate(names))
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(n) for n in names])).collect()]


def test_normalize_key(spark):
    assert run(spark, t.normalize_key, ("  The  Kitt's, House ",), (None,), ("É-Ü_1",), ("",)) == ["the kitts house", "", "éü_1", ""]


def test_postcode_and_provider(spark):
    assert run(spark, t.postcode_key, ("W1T 4PX",), ("w1t4px",), (None,)) == ["w1t4px", "w1t4px", ""]
    got = run(spark, t.clean_provider, ("WORKPLACE+",), ("Metspace",), ("Copthall Estates Availibility",), ("Availability",), (None,), ("New Co",))
    assert got == ["Workplace Plus", "MetSpace", "Copthall Estates", "Availability", None, "New Co"]


def test_house_numbers(spark):
    assert run(spark, t.house_number, ("14-18 Plover Avenue",), (" 56A High St",), ("Larch House",), ("28th Floor",), (None,)) == ["14-18", "56a", None, None, None]
    assert run(spark, t.house_number_changed, ("18 X", "14-18 X"), ("18 X", " 18 X"), ("18 X", "X"), ("X", "Y")) == [True, False, True, False]
    assert run(spark, t.street_key, ("61 Marigold St",), ("Marigold Street",), ("12",), (None,)) == ["marigold street", "marigold street", "", ""]


def test_compound(spark):
    got = run(spark, lambda c: F.concat_ws("|", t.compound_split(c)["name"], t.compound_split(c)["address"]), ("Heron House, 31 Quince Street",), ("Larch House",), ("52 Larch Street",), ("Cedar House - 7 Plover Street",))
    assert got == ["Heron House|31 Quince Street", "", "", "Cedar House|7 Plover Street"]


@pytest.mark.parametrize(("text", "gone"), [("Let", True), ("pre-let demand", False), ("re-let and let", True), ("outlet", False), ("UNDER OFFER", True), ("100% Occupied", True), (None, False), ("leaseder", False)])
def test_let_status(spark, text, gone):
    assert run(spark, t.mentions_let_status, (text,)) == [gone]


def test_numbers(spark):
    got = run(spark, lambda c: t.coerce_number(c, "int"), ("38.5",), ("39.5",), ("1,250",), ("12d",), ("inf",), (None,), ("POA",))
    assert got == [38, 40, 1250, None, None, None, None]


def test_rent(spark):
    both = lambda s, m, f: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in t.derive_rent(s, m, f)])
    assert run(spark, both, (1200.0, 5000.0, None), (1200.0, 0.0, 50.0), (None, 5000.0, None), (1200.0, 1.0, 2.0), kinds=["double"] * 3) == ["5000.0|50.0", "5000.0|50.0", "5000.0|-", "1.0|2.0"]


def test_detail(spark):
    assert run(spark, t.detail_loss, ("Terrace with views; Bike store", "bike store"), ("Terrace", "large terrace; gym"), ("A; bb", None), ("Terrace", None)) == [True, False, False, True]
    assert run(spark, t.richness_regression, ("a b c d", "a"), ("a b c d", "a b"), ("", "x")) == [True, False, False]


def test_london_time(spark):
    got = run(spark, t.london_time, ("2026-07-01_10-00-00-123",), ("2026-01-05T09:30:00",), ("soon",), (None,))
    assert got == ["2026-07-01 11:00 BST", "2026-01-05 09:30 GMT", "soon", None]


def test_links(spark):
    assert run(spark, links.is_generic_link, ("https://uk.linkedin.com/in/x",), ("example.org",), ("https://example.org/a.pdf",), ("https://example.org/?id=1",)) == [True, True, False, False]
    assert run(spark, links.score_link, ("/a/Brochure.PDF?x", ""), ("/a.pdf", ""), ("/a.pdf", "Our Brochure"), ("/x", "Download"), ("/x", "Home")) == [3, 2, 3, 1, 0]
    wrapped = "https://x.dynamics.com/a?msdynmkt_target=%7B%22TargetUrl%22%3A%22https%253A%252F%252Fexample.org%252Fb%22%7D"
    assert run(spark, links.unwrap_tracking, (wrapped,), ("https://example.org/?msdynmkt_target=1",)) == ["https://example.org/b", None]
    assert run(spark, splice_house_number, ("12 High St", "14"), ("High St", "14")) == ["14 High St", "14 High St"]

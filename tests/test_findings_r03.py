"""Cases of the third round's findings."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.functions.schema import KINDS
from ledgerline.operators import geocode, links
from ledgerline.plans.checkpoints import writer
from ledgerline.plans.upload import mapped_rows
from ledgerline.queries import ORACLES, QUERIES
from ledgerline.sources import mapping
from ledgerline.sources.xlsx import read_cells, read_lines, scan_upload, sheet_cells, write_workbook

DATA = "/root/testdata/sf0.001"


def test_link_hops_with_pages_at_one_address(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").where("page_id < 40")
    shared = F.when(F.col("page_id") % 3 == 0, "http://one.example.org/a#b").otherwise(F.col("url"))
    pages.withColumn("url", shared).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["link_hops"](spark, str(tmp_path)).select("url", "link", "outcome", "hops").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(ORACLES["link_hops"]).select("url", "link", "outcome", "hops").fetchall())


def test_headers_of_one_file_are_many_tasks_and_compared_once(spark):
    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string"), F.array(F.lit("Bilding"), F.lit("Legal Structure"), F.lit("Montly Rate")).alias("headers"))
    found = mapping.map_headers(rows)
    assert found.rdd.getNumPartitions() > 1
    assert {tuple(r)[1:] for r in found.collect()} == {("Bilding", "building"), ("Legal Structure", None), ("Montly Rate", "rent_pcm")}
    before = mapping._field_likeness.cache_info().misses
    for _ in range(3):
        mapping.suggest_mapping(["Bilding", "Legal Structure", "Montly Rate"])
    assert mapping._field_likeness.cache_info().misses - before <= 3 * len(KINDS)


def test_words_that_are_alike_by_all_comparisons():
    words = ["building", "bilding", "rate", "rates", "montly", "monthly", "sq", "ft", "sqft", "post-code", "postcode", "aab", "baa"]
    for x in words:
        for y in words:
            whole = float(x == y) if min(len(x), len(y)) < 3 else difflib.SequenceMatcher(None, x, y).ratio()
            assert mapping._like(x, y) == (whole if whole >= mapping.LIKE else 0.0)


def _uses(df, column):
    return df._jdf.queryExecution().optimizedPlan().expressions().mkString(" ").count(f"{column}#")


def test_text_rules_read_a_text_once(spark):
    rows = spark.createDataFrame([("a; gym hall <http://x.example/a> b", "gym hall; pool")], "o string, n string")
    assert _uses(rows.select(links.resolve_email_links(F.col("o"))), "o") == 2  # what stands between links, and the links
    loss = rows.select(text.detail_loss(F.col("o"), F.col("n")))
    assert (_uses(loss, "o"), _uses(loss, "n")) == (1, 1)
    assert rows.select(text.detail_loss(F.col("o"), F.col("n")).alias("x"), text.detail_loss(F.col("n"), F.lit("gym hall; a pool")).alias("y")).first()[1] is False


def test_narrow_files_with_much_work_are_many_tasks(spark):
    for name in ("email_links", "risky_changes"):
        assert QUERIES[name](spark, DATA).rdd.getNumPartitions() > 1


def test_scan_of_settled_sheets_reads_their_headers_only(spark, tmp_path):
    """A scan opens lines of doubtful sheets alone, and rows come from lines, not from cells put together again."""
    for k in range(3):
        names = ["Building", "Floor", "Rent Pcm"] if k < 2 else ["What", "Else", "Is"]
        (tmp_path / f"f{k}.xlsx").write_bytes(write_workbook([{"a": f"Kent {i}", "b": str(i), "c": i * 10.5} for i in range(5)], ["a", "b", "c"], names))
    path = str(tmp_path)
    scan = writer(spark)(scan_upload(spark, path), "scan")
    assert {r.file[-7:]: r.outcome for r in scan.collect()} == {"f0.xlsx": None, "f1.xlsx": None, "f2.xlsx": "authoritative"}
    doubtful = sheet_cells(spark, path, scan.where("outcome is not null").select("file", "position"))
    assert {r.file[-7:] for r in doubtful.collect()} == {"f2.xlsx"}
    lines, cells = mapped_rows(read_lines(spark, path), scan), mapped_rows(read_cells(spark, path), scan)
    assert sorted(map(str, lines.collect())) == sorted(map(str, cells.collect())) and lines.count() == 10
    assert {(r.building, r.floor_unit, r.rent_pcm) for r in lines.collect()} == {(f"Kent {i}", str(i), i * 10.5) for i in range(5)}
    assert "Exchange hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_growing_cells_equals_one_grid(spark):
    r = random.Random(4)
    place = lambda n, wide: [(51.5 + r.random() * wide, -0.1 + r.random() * wide, f"k{i}") for i in range(n)]
    some = place(400, 2e-4) + place(100, 3e-3)
    spots = spark.createDataFrame([x[:2] for x in place(300, 2e-4) + place(100, 3e-3) + some[:20]] + [(None, 0.0)], "lat double, lng double")
    answers = spark.createDataFrame(some + [(a, b, f"a{k}") for a, b, k in some[:5]], "lat double, lng double, key string")
    names = []

    def checkpoint(df, name):
        names.append((name, df.count()))
        return writer(spark)(df, name)

    got = geocode.nearest(spots, answers, "key", checkpoint=checkpoint)
    assert sorted(map(str, got.collect())) == sorted(map(str, geocode.nearest(spots, answers, "key").collect()))
    assert len([n for name, n in names if name == "nearest" and n]) == 4  # every grid settles some spots

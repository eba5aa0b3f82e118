"""Commits of the master: interleaved writers, deaths between any two steps, buckets that stay, restores without a rewrite."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import table as tables
from ledgerline.plans.checkpoints import numbered, writer
from ledgerline.plans.table import CommitConflict, MasterTable
from ledgerline.sources.documents import content_hash
from ledgerline.streaming.ingest import merge_batch, run_available

from .test_merge import row, rows


class Killed(BaseException):
    """A death of the driver: nothing that catches errors sees it."""


def names(table):
    return sorted(r.building for r in table.read().collect())


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.glob("data/*/bucket=*/part-*.parquet")}


def inserting(spark, *new):
    empty = spark.createDataFrame([], "_pos long, field string, value string")
    return lambda master: (empty, rows(spark, *new), None)


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    a, b = (MasterTable(spark, f"file://{tmp_path}/m") for _ in range(2))
    a.write(rows(spark, row("A")))
    mine, theirs = a.read(), b.read()
    a.write(mine.unionByName(rows(spark, row("B")).withColumn("_pos", F.lit(7).cast("long"))))
    with pytest.raises(CommitConflict):
        b.write(theirs.unionByName(rows(spark, row("C")).withColumn("_pos", F.lit(7).cast("long"))))
    assert names(a) == ["A", "B"]
    log = a.read_log()
    assert log.where("success").count() == 2 and log.where("not success").count() == 1


def test_two_merges_that_interleave_both_stay(spark, tmp_path):
    a, b = (MasterTable(spark, f"file://{tmp_path}/m", 2) for _ in range(2))
    a.write(rows(spark, row("A"), row("B"), row("C")))
    first, asked = inserting(spark, row("X")), []

    def change(master):
        asked.append(sorted(r.building for r in master.collect()))
        if len(asked) == 1:  # the other one commits while this one is at work
            b.merge(inserting(spark, row("Y"), row("Z")), writer(spark))
        return first(master)

    a.merge(change, writer(spark))
    assert asked == [["A", "B", "C"], ["A", "B", "C", "Y", "Z"]]
    assert names(a) == ["A", "B", "C", "X", "Y", "Z"] and a.state()["version"] == 3
    assert sorted(r._pos for r in a.read().collect()) == list(range(6))


def test_a_commit_number_is_made_once(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/m")
    table._create_text("versions/1.json", "one")
    with pytest.raises(CommitConflict):
        table._create_text("versions/1.json", "two")
    assert table._read_text("versions/1.json") == "one" and [p.name for p in (tmp_path / "m").glob(".*.part")] == []


def test_a_merge_writes_what_it_touches(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/m", 10)
    table.write(rows(spark, *[row(f"B{k}", provider=f"P{k % 3}", property_id=f"i{k}") for k in range(95)]))
    before = files(tmp_path / "m")
    assert len(before) == 10

    def change(master):
        told = spark.createDataFrame([(3, "postcode", "N1"), (31, "size_sqft", "5"), (31, "nope", "x")], "_pos long, field string, value string")
        return told, rows(spark, *[row(f"N{k}") for k in range(7)]), spark.createDataFrame([(50,), (None,), (999,)], "_pos long")

    table.merge(change, writer(spark), "merge", new_count=7)
    new = set(files(tmp_path / "m")) - set(before)
    assert {p.split("/")[2] for p in new} == {"bucket=0", "bucket=3", "bucket=5", "bucket=9", "bucket=10"}
    assert all(before[p] == t for p, t in files(tmp_path / "m").items() if p in before)
    got = {r._pos: r for r in table.read().collect()}
    assert len(got) == 101 and got[3].postcode == "N1" and got[31].size_sqft == 5.0 and 50 not in got
    assert [got[k].building for k in range(95, 102)] == [f"N{k}" for k in range(7)]
    assert table.read_log().where("new_count = 7").first().row_count == 101
    want = sorted(((r.provider is None, r.provider.lower(), p) for p, r in got.items()))
    assert [(False, r.provider.lower(), r._pos) for r in table.ordered().collect()] == want


def test_a_merge_of_nothing_and_of_everything(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/m", 4)
    none = spark.createDataFrame([], "_pos long, field string, value string")
    table.merge(lambda m: (none, rows(spark), None), writer(spark))
    assert table.read().count() == 0 and table.state()["top"] == -1
    table.merge(inserting(spark, row("A"), row("B")), writer(spark))
    table.merge(lambda m: (none, rows(spark), m.select("_pos")), writer(spark))
    assert table.read().count() == 0 and table.state()["buckets"] == {}
    table.merge(inserting(spark, row("C")), writer(spark))
    assert [(r.building, r._pos) for r in table.read().collect()] == [("C", 2)]  # positions are never given twice


def test_a_restore_names_the_same_files(spark, tmp_path):
    table = MasterTable(spark, f"file://{tmp_path}/m", 2)
    first = table.write(rows(spark, row("A"), row("B"), row("C")))
    table.merge(inserting(spark, row("D")), writer(spark))
    before = files(tmp_path / "m")
    table.restore(first)
    assert files(tmp_path / "m") == before and names(table) == ["A", "B", "C"]
    assert table.state()["buckets"] == table.state(first.rpartition("/")[2])["buckets"]
    assert table.versions().first().source == f"restore:{first}"
    table.merge(inserting(spark, row("E")), writer(spark))
    assert {r.building: r._pos for r in table.read().collect()}["E"] == 4
    next((tmp_path / "m" / table.state(first.rpartition("/")[2])["buckets"]["0"]["path"]).glob("part-*")).unlink()
    with pytest.raises(ValueError, match="rows of 3"):
        table.restore(first)


def test_retention_counts_references(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "KEEP_VERSIONS", 2)
    table = MasterTable(spark, f"file://{tmp_path}/m", 2)
    first = table.write(rows(spark, row("A", property_id="a"), row("B", property_id="b"), row("C", property_id="c"), row("D", property_id="d")))
    for k in range(3):
        told = spark.createDataFrame([(0, "postcode", f"N{k}")], "_pos long, field string, value string")
        table.merge(lambda m, told=told: (told, rows(spark), None), writer(spark))
    left = {p.split("/")[2] for p in files(tmp_path / "m")}
    assert len(files(tmp_path / "m")) == 3 and left == {"bucket=0", "bucket=1"}  # two of the first bucket, and the one that all share
    assert names(table) == ["A", "B", "C", "D"] and len(table._names()) == 2 and table.read_log().where("success").count() == 4
    with pytest.raises(ValueError, match="no longer kept"):
        table.restore(first)


@pytest.mark.parametrize("step", ["_write_buckets", "_create_text", "_retain"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_streamed_batch_that_dies_is_merged_once(spark, tmp_path, monkeypatch, step, when):
    table = MasterTable(spark, f"file://{tmp_path}/m", 2)
    table.write(rows(spark, row("A"), row("B"), row("C")))
    batch = rows(spark, row("A", rent_pcm=2.0), row("New"))
    plain, dead = getattr(table, step), []

    def die(*args):
        out = plain(*args) if when == "after" else None
        if not dead:
            dead.append(step)
            raise Killed
        return out if when == "after" else plain(*args)

    monkeypatch.setattr(table, step, die)
    with pytest.raises(Killed):
        merge_batch(table, batch, 4, writer(spark))
    fresh = MasterTable(spark, f"file://{tmp_path}/m", 2)
    merge_batch(fresh, batch, 4, writer(spark))
    assert merge_batch(fresh, batch, 4, writer(spark)) is None
    assert names(fresh) == ["A", "B", "C", "New"] and fresh.state()["version"] == 2
    assert fresh.read_log().where("source = 'stream:4' and success").count() == 1


def upload(spark, folder, name, *values):
    rows(spark, *values).drop("_pos").coalesce(1).write.parquet(f"{folder}/../made-{name}")
    made = next((folder / f"../made-{name}").glob("part-*.parquet")).read_bytes()
    (folder / f"{name}.parquet").write_bytes(made)
    return made


def test_one_content_under_two_names(spark, tmp_path):
    folder, gone = tmp_path / "in", tmp_path / "gone"
    folder.mkdir()
    gone.mkdir()
    table = MasterTable(spark, f"file://{tmp_path}/m")
    run = lambda: run_available(spark, str(folder), table, str(tmp_path / "cp"), writer(spark), str(gone))
    made = upload(spark, folder, "a", row("A"))
    (folder / "b.parquet").write_bytes(made)
    run()
    assert names(table) == ["A"] and table.state()["version"] == 1
    (folder / "c.parquet").write_bytes(made)
    run()
    assert table.state()["version"] == 1
    upload(spark, folder, "d", row("D"))
    run()
    assert names(table) == ["A", "D"]
    table.merge(lambda m: (spark.createDataFrame([], "_pos long, field string, value string"), rows(spark), m.where("building = 'A'").select("_pos")), writer(spark))
    (key,) = spark.createDataFrame([(bytearray(made),)], "c binary").select(content_hash(F.col("c"), "1")).first()
    (gone / "one.json").write_text(json.dumps({"content_hash": key, "at": "2000-01-01T00:00:00Z"}) + "\n")
    run()
    (folder / "e.parquet").write_bytes(made)
    run()
    assert names(table) == ["A", "D"]


def test_numbered(spark):
    df = spark.range(0, 1000, 7, 5).selectExpr("1000 - id as k", "id as v")
    got = sorted((r.p, r.k) for r in numbered(df, ["k"], "p", writer(spark)).collect())
    assert [p for p, _ in got] == list(range(143)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(df.limit(0), ["k"], "p", writer(spark)).count() == 0

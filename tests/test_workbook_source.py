"""Workbooks as data sources: tasks by sheet, pushed filters, the distributed writer and its failures."""

import io
import math
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.sources.ooxml import workbook_cells, workbook_sheets, write_sheet
from ledgerline.sources.workbook_source import SheetWriter, register
from ledgerline.sources.xlsx import list_sheets, read_cells, sheet_headers, sheet_table

from .test_uploads import two_sheets, workbook


@pytest.fixture
def folder(tmp_path):
    one = workbook(["Building", "Floor"], *[[f"B{k}", k] for k in range(300)])
    two = workbook(["Name"], ["x"], ["y"])
    (tmp_path / "a b.xlsx").write_bytes(two_sheets(one, two))
    (tmp_path / "c.xlsx").write_bytes(two)
    (tmp_path / "~notes.txt").write_text("no workbook")
    (tmp_path / "_hidden.xlsx").write_bytes(b"not read")
    return tmp_path


def test_a_task_for_each_sheet_of_a_large_file(spark, folder):
    register(spark)
    whole = spark.read.format("workbook").load(str(folder))
    split = spark.read.format("workbook").option("splitBytes", "1").load(str(folder))
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and whole.count() == 602 + 3 + 3
    one = spark.read.format("workbook").option("splitBytes", "1").option("sheets", '["Archive"]').load(str(folder))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3


def test_sheets_and_lines_by_options(spark, folder):
    cells = read_cells(spark, str(folder))
    every = cells.collect()
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(read_cells(spark, str(folder), ["Archive"])) == sorted(tuple(r) for r in every if r.sheet == "Archive")
    assert told(read_cells(spark, str(folder), last_row=2)) == sorted(tuple(r) for r in every if r.row_no <= 2)
    assert read_cells(spark, str(folder), []).count() == 0 == read_cells(spark, str(folder), ["none"]).count()
    hidden = spark.read.format("workbook").option("states", '["hidden"]').option("firstRow", 3).load(str(folder))
    assert told(hidden) == sorted(tuple(r) for r in every if r.sheet_state == "hidden" and r.row_no >= 3)
    # filters of one plan leave the next alone
    assert cells.where("sheet = 'Archive'").count() == 3 and cells.count() == len(every)


def test_wanted_lines_end_the_parse():
    out = io.BytesIO()
    write_sheet(out, ["n"], ([k] for k in range(50_000)))
    assert [c[4] for c in workbook_cells(out.getvalue(), last=2)] == ["n", "0"]
    assert [c[2] for c in workbook_cells(out.getvalue(), first=3, last=4)] == [3, 4]
    assert list(workbook_cells(out.getvalue(), first=5, last=4)) == [] == list(workbook_cells(out.getvalue(), lambda *_: False))


def test_sheets_and_an_empty_folder(spark, folder, tmp_path):
    got = [(os.path.basename(r.file), r.position, r.sheet, r.sheet_state) for r in list_sheets(spark, str(folder)).orderBy("file", "position").collect()]
    assert got == [("a b.xlsx", 0, "Sheet1", "visible"), ("a b.xlsx", 1, "Archive", "hidden"), ("c.xlsx", 0, "Sheet1", "visible")]
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "?*.xlsx").load(str(folder)).select("path")
    assert {r.file for r in list_sheets(spark, str(folder)).collect()} == {r.path for r in binary.collect()}
    (tmp_path / "none").mkdir()
    assert read_cells(spark, str(tmp_path / "none")).count() == 0 == list_sheets(spark, str(tmp_path / "none")).count()


def test_written_in_parts_and_read_back(spark, tmp_path):
    rows = spark.range(1000).select(
        F.col("id").alias("n"), F.concat(F.lit("a & <b> \"c\" \u0001é "), "id").alias("Some Text"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("https://example.org/?a=1&b="), "id")).alias("link"),
        F.when(F.col("id") % 2 == 0, F.lit(math.nan)).otherwise(F.col("id") / 4).alias("x"), (F.col("id") % 3 == 0).alias("b"),
    ).repartition(3)
    path = str(tmp_path / "out")
    register(spark)
    rows.write.format("workbook").mode("append").option("sheet", "R&D").option("partRows", "100").save(path)
    files = [f for f in os.listdir(path)]
    assert 10 <= len(files) <= 13 and all(f.startswith("part-") for f in files)
    assert {s for f in files for s in workbook_sheets((tmp_path / "out" / f).read_bytes())} == {("R&D", "visible")}
    cells = read_cells(spark, path)
    wide = cells.where("row_no > 1").groupBy("file", "row_no").pivot("col_no", [1, 2, 3, 4, 5]).agg(F.first(F.coalesce("hyperlink", "value")))
    got = {int(r["1"]): tuple(r[2:]) for r in wide.collect()}
    text = lambda k: (str(k), f'a & <b> "c" é {k}', f"https://example.org/?a=1&b={k}" if k % 7 == 0 else None, str(k / 4) if k % 2 else None, str(int(k % 3 == 0)))
    assert got == {k: text(k) for k in range(1000)}
    one = cells.where(F.col("file").endswith(files[0]))
    assert sheet_headers(one) == ["n", "Some Text", "link", "x", "b"] and sheet_table(one, ["n", "t"]).count() <= 100


def test_overwrite_empty_and_failure(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "out")
    save = lambda df, mode: df.write.format("workbook").mode(mode).save(path)
    save(spark.range(3), "append")
    save(spark.range(5), "append")
    assert read_cells(spark, path).where("row_no > 1").count() == 8
    bad = spark.range(8).repartition(2).select(F.raise_error(F.lit("broken")).cast("string").alias("e"))
    with pytest.raises(Exception, match="broken"):
        save(bad, "overwrite")
    assert read_cells(spark, path).where("row_no > 1").count() == 8 and not [f for f in os.listdir(path) if f.startswith(".")]
    save(spark.range(0), "overwrite")
    assert [r.value for r in read_cells(spark, path).collect()] == ["id"] and len(os.listdir(path)) == 1


def test_only_files_of_told_tasks_stay(tmp_path):
    w = SheetWriter(str(tmp_path / "out"), ["a"], "S", 10, False)
    lost, told = w.write(iter([(1,)])), w.write(iter([(k,) for k in range(25)]))
    assert (lost.rows, told.rows, len(told.files)) == (1, 25, 3) and w.write(iter([])).files == []
    w.commit([told, None])
    assert sorted(os.listdir(tmp_path / "out")) == sorted(told.files)


def test_links_beyond_a_sheets_limit_begin_the_next(tmp_path):
    rows = iter([[f"https://e.org/{k}"] for k in range(70_000)])
    first, second = io.BytesIO(), io.BytesIO()
    n = write_sheet(first, ["u"], rows)
    assert n == 65_530 and n + write_sheet(second, ["u"], rows) == 70_000
    assert next(workbook_cells(second.getvalue(), first=2))[-1] == "https://e.org/65530"

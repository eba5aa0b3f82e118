"""Files of an upload: sheets and their headers, kept rescues, CSV and mail; the master under failures; whole plans."""

import difflib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.schema import KINDS, LISTING, title_label
from ledgerline.operators.match import match_batch
from ledgerline.plans import table as tables
from ledgerline.plans.merge import apply_merge
from ledgerline.plans.table import MasterTable, RescueStore
from ledgerline.sources import mapping
from ledgerline.sources.documents import read_csv, read_emails
from ledgerline.sources.xlsx import list_sheets, read_cells, read_listing, scan_upload, write_workbook

from .test_merge import row, rows


def two_sheets(first: bytes, second: bytes, state: str = "hidden") -> bytes:
    """The sheets of two workbooks in one, the second in another state."""
    a, b = (zipfile.ZipFile(io.BytesIO(x)) for x in (first, second))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in a.namelist():
            text = a.read(name).decode()
            if name == "xl/workbook.xml":
                text = text.replace("</sheets>", f'<sheet name="Archive" sheetId="2" state="{state}" r:id="rId2"/></sheets>')
            if name == "xl/_rels/workbook.xml.rels":
                text = text.replace("</Relationships>", '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet2.xml", b.read("xl/worksheets/sheet1.xml"))
    return out.getvalue()


def workbook(headers, *values):
    cols = [f"c{k}" for k in range(len(headers))]
    return write_workbook([dict(zip(cols, v, strict=True)) for v in values], cols, headers)


def test_scan_upload(spark, tmp_path):
    good = workbook(["Building", "Floor/Unit"], ["A", "1"])
    odd = workbook(["Soho", "Level"], ["A", "1"], ["Units updated 1/2/2025", "x"])
    (tmp_path / "mixed.xlsx").write_bytes(two_sheets(good, odd))
    (tmp_path / "odd.xlsx").write_bytes(odd)
    (tmp_path / "plain.csv").write_text("Building,Floor\nA,1\n")
    names = [(r.file.rsplit("/", 1)[-1], r.position, r.sheet, r.sheet_state) for r in list_sheets(spark, str(tmp_path)).orderBy("file", "position").collect()]
    assert names == [("mixed.xlsx", 0, "Sheet1", "visible"), ("mixed.xlsx", 1, "Archive", "hidden"), ("odd.xlsx", 0, "Sheet1", "visible"), ("plain.csv", 0, None, "visible")]
    scan = {(r.file.rsplit("/", 1)[-1], r.sheet): r for r in scan_upload(spark, str(tmp_path)).collect()}
    assert len(scan) == 3
    assert scan["mixed.xlsx", "Sheet1"].unresolved == [] and scan["mixed.xlsx", "Sheet1"].outcome is None
    assert scan["mixed.xlsx", "Archive"].outcome == "auto_skip" and scan["odd.xlsx", "Sheet1"].outcome == "authoritative"
    assert scan["odd.xlsx", "Sheet1"].unresolved == ["building"] and scan["odd.xlsx", "Sheet1"].header_hash == mapping.header_hash(["Soho", "Level"])
    store = RescueStore(spark, f"file://{tmp_path}/store")
    assert store.lookup(["x"]) == {}
    store.save(["Soho", "Level"], {"building": "Other"})
    store.save(["Soho", "Level"], {"building": "Soho"})
    kept = store.lookup([r.header_hash for r in scan.values()])
    again = {(r.file.rsplit("/", 1)[-1], r.sheet): r for r in scan_upload(spark, str(tmp_path), kept).collect()}
    assert again["odd.xlsx", "Sheet1"].unresolved == [] and again["odd.xlsx", "Sheet1"].mapping["Soho"] == "building"


def test_own_headers_in_any_order(spark, tmp_path):
    fields = [f for f in reversed(KINDS) if f not in ("desks_min", "contacts")]
    data = write_workbook([{f: {"building": "A", "size_sqft": 12.5, "brochure_link": "https://example.org/a.pdf"}.get(f) for f in fields} | {"old": "x"}], [*fields, "old"], [*map(title_label, fields), "Gone Column"])
    (tmp_path / "own.xlsx").write_bytes(data)
    (got,) = read_listing(read_cells(spark, str(tmp_path))).drop("_pos").collect()
    assert got.asDict() == dict.fromkeys(KINDS) | {"building": "A", "size_sqft": 12.5, "brochure_link": "https://example.org/a.pdf"}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Building,"Key ""features"""\nA,"one\ntwo"\n"B, C",\n')
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("A", "one\ntwo"), ("B, C", None)]


def test_mail(spark, tmp_path):
    head = "From: a@example.org\nSubject: s\nMIME-Version: 1.0\nContent-Type: text/{}; charset={}\n\n"
    (tmp_path / "a.eml").write_text(head.format("plain", "utf-8") + "One <https://example.org/a/b.pdf>\n\n\n\nTwo <https://example.org/unsubscribe>\n")
    (tmp_path / "b.eml").write_text(head.format("html", "no-such-charset") + "<p>Three</p><b>Four</b>\n")
    (tmp_path / "c.eml").write_text("From: a@example.org\nContent-Type: image/png\n\nx\n")
    got = {r.file.rsplit("/", 1)[-1]: r.body for r in read_emails(spark, str(tmp_path)).collect()}
    assert got["a.eml"].split("\n") == ["One https://example.org/a/b.pdf", "", "Two"] and got["b.eml"].split() == ["Three", "Four"] and got["c.eml"] is None


def test_a_write_that_dies_leaves_the_old_master(spark, tmp_path, monkeypatch):
    master = MasterTable(spark, f"file://{tmp_path}/m")
    master.write(rows(spark, row("A"), row("B")))

    def down(*_):
        raise OSError("down")

    monkeypatch.setattr(tables.os, "link", down)
    with pytest.raises(Exception, match="down"):
        master.write(rows(spark, row("C")))
    assert sorted(r.building for r in MasterTable(spark, f"file://{tmp_path}/m").read().collect()) == ["A", "B"]


def test_rows_are_computed_once_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "KEEP_VERSIONS", 2)
    master = MasterTable(spark, f"file://{tmp_path}/m")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    few = rows(spark, *[row(f"B{k}", provider="P") for k in range(50)]).coalesce(1)
    for _ in range(3):
        master.write(few)
    assert len(master._names()) == 2 and master.versions().count() == 2 and master.read().count() == 50
    master.write(few.mapInPandas(count, few.schema).coalesce(1))
    assert seen.value <= 100  # once for the rows, at most once more for the ranges of the order


def test_words_do_not_erase_numbers(spark):
    master = rows(spark, row("A", size_sqft=5.0, postcode="N1"))
    told = spark.createDataFrame([(0, "size_sqft", "about six"), (0, "postcode", None)], "_pos long, field string, value string")
    (got,) = apply_merge(master, told, master.limit(0)).collect()
    assert (got.size_sqft, got.postcode) == (5.0, None)


def plain_match(batch, master):
    """The three tiers by loops."""
    norm = lambda t: " ".join("".join(ch for ch in (t or "").lower() if ch.isalnum() or ch.isspace()).split())
    keys = lambda r: (norm(r["building"]), norm(r["provider"]), norm(r["floor_unit"]))
    code = lambda r: norm(r["postcode"]).replace(" ", "")
    plain = lambda r: bool(r["building"]) and not any(ch.isdigit() for ch in r["building"])
    out = []
    for b in batch:
        tier = [(n, m) for n, m in enumerate(master) if keys(m) == keys(b) and code(m) and code(m) == code(b)]
        name = "postcode"
        if len(tier) != 1:
            tier, name = [(n, m) for n, m in enumerate(master) if keys(m) == keys(b)], "fallback"
        if len(tier) != 1 and plain(b):
            near = lambda m: difflib.SequenceMatcher(None, norm(b["building"].split(", ")[0]), norm(m["building"].split(", ")[0])).ratio() >= 0.85  # noqa: B023, E731
            tier, name = [(n, m) for n, m in enumerate(master) if plain(m) and keys(m)[1:] == keys(b)[1:] and near(m)], "fuzzy_building"
        out.append((name, tier[0][0]) if len(tier) == 1 else (None, None))
    return out


def test_all_tiers_against_loops(spark):
    names = ["Heron House", "Heron Hause", "Larch Court", "Larch Cort, City", "Plover 12", "Plover 13", "Quince", "Quinces", "Cedar Hall", "cedar hall."]
    master = [row(n, floor=str(k % 2), postcode=f"N{k}" if k % 3 else None) for k, n in enumerate(names)]
    batch = [row(n + x, floor=str(k % 2), postcode=f"n {k}" if k % 2 else "W1") for k, n in enumerate(names) for x in ("", "e", " X")]
    fill = lambda r: dict.fromkeys(KINDS) | r
    got = match_batch(rows(spark, *batch).withColumnRenamed("_pos", "_b"), rows(spark, *master)).orderBy("_b").collect()
    assert [(r.match_tier, r.master and r.master["_pos"]) for r in got] == plain_match([fill(b) for b in batch], [fill(m) for m in master])
    assert {r.match_tier for r in got} == {None, "postcode", "fallback", "fuzzy_building"} and LISTING["building"].nullable is False

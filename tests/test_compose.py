"""A fixture upload from its files to staged rows, and large workbooks in bounded memory."""

import tracemalloc
import zipfile

from ledgerline.functions.schema import KINDS
from ledgerline.plans.checkpoints import writer
from ledgerline.plans.table import RescueStore, Staging
from ledgerline.plans.upload import stage_uploads, upload_rows
from ledgerline.sources import xlsx

from .test_uploads import two_sheets, workbook

UNION = ["Clerkenwell & Farringdon", "Floor", "Current spec", "Size sq.ft", "Minimum Term", "Monthly Rate", "Price p/sq.ft", "Brochure"]


def placed(rows):
    told = ("provider", "internal_ref", "submarket", "building", "floor_unit", "size_sqft", "rent_pcm", "address_1", "postcode", "lat", "brochure_link", "source_file")
    return [tuple(r[c] for c in told) for r in rows]


def test_from_files_to_staged_rows(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "UNION - Clerkenwell & Farringdon.xlsx").write_bytes(workbook(UNION, ["7 Larch Row", "1", "Fitted", 1200, "1 year", 5000, 50, "https://e.org/a.pdf"], ["  ", "2", "x", 1, "", 1, 1, None], ["Heron Hall", "3", "CAT A", "1,350", None, None, None, None]))
    known = workbook(["Building", "Floor/Unit", "Provider", "Submarket", "Address 1", "Postcode", "Building"], ["Quince House", "G", "Own", "Soho", "9 Quince St", "W1 1AA", "second"], ["12 Plover St", "2", None, None, None, None, "x"])
    hidden = workbook(["Soho", "Level"], ["Z", "1"])
    (folder / "Acme Estates Availability 12-03-2026.xlsx").write_bytes(two_sheets(known, hidden))
    place = "array<struct<name:string,types:array<string>>>"
    street = [("5", ["street_number"]), ("Hall Lane", ["route"]), ("EC1 2AB", ["postal_code"])]
    responses = spark.createDataFrame([("Heron Hall, Clerkenwell & Farringdon, London, UK", "places", "OK", 51.52, -0.1, street), ("9 Quince St, W1 1AA, UK", "geocode", "OK", 51.51, -0.13, []), ("51.51,-0.13", "reverse", "OK", None, None, [("Elsewhere", ["sublocality"])])], f"query string, kind string, status string, lat double, lng double, components {place}")
    acme, union, area = "Acme Estates Availability 12-03-2026.xlsx", "UNION - Clerkenwell & Farringdon.xlsx", "Clerkenwell & Farringdon"
    want = [
        ("Own", "Own", "Soho", "Quince House", "G", None, None, "9 Quince St", "W1 1AA", 51.51, None, acme),
        ("Acme Estates", "Acme Estates", None, "12 Plover St", "2", None, None, "12 Plover St", None, None, None, acme),
        ("UNION", "UNION", area, "7 Larch Row", "1", 1200.0, 5000.0, "7 Larch Row", None, None, "https://e.org/a.pdf", union),
        ("UNION", "UNION", area, "Heron Hall", "3", 1350.0, None, "5 Hall Lane", "EC1 2AB", 51.52, None, union),
    ]
    made = upload_rows(spark, str(folder), writer(spark), responses=responses).orderBy("_pos").collect()
    assert placed(made) == want and [r._pos for r in made] == [0, 1, 2, 3]
    staging = Staging(spark, f"file://{tmp_path}/staging")
    batches = stage_uploads(spark, str(folder), staging, writer(spark), responses=responses)
    assert sorted(batches) == [acme, union] and placed(staging.union().select(*KINDS, "_pos").orderBy("_pos").collect()) == want
    assert {r.filename: r.n_rows for r in staging.pending().collect()} == {acme: 2, union: 2}
    assert stage_uploads(spark, str(folder), staging, writer(spark)) == {}
    store = RescueStore(spark, f"file://{tmp_path}/rescues")
    key = store.save(["Soho", "Level"], {"building": "Soho"})
    rescued = upload_rows(spark, str(folder), writer(spark), rescues=store.lookup([key])).where("building = 'Z'").collect()
    assert [(r.source_file, r.provider) for r in rescued] == [(acme, "Acme Estates")]
    staging.discard(batches[union])
    assert list(stage_uploads(spark, str(folder), staging, writer(spark))) == [union]


def test_a_large_sheet_is_read_in_parts(spark, tmp_path):
    body = "".join(f'<row r="{n}"><c r="A{n}" t="s"><v>{n % 3}</v></c><c r="B{n}"><v>{n}</v></c><c r="C{n}" t="inlineStr"><is><t>{"x" * 60}{n}</t></is></c></row>' for n in range(1, 60_001))
    base = workbook(["a"], ["b"])
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for name in z.namelist():
            text = z.read(name).decode()
            if name.endswith("sheet1.xml"):
                text = text[: text.index("<sheetData>")] + f"<sheetData>{body}</sheetData></worksheet>"
            w.writestr(name, text)
        w.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>p</t></si><si><r><t>q</t></r><r><t>r</t></r></si><si><t>s</t></si></sst>')
    (tmp_path / "large.xlsx").write_bytes(out.getvalue())
    tracemalloc.start()
    cells = xlsx.workbook_cells(out.getvalue())
    for n, got in enumerate(cells):
        assert got == ("Sheet1", "visible", n // 3 + 1, n % 3 + 1, [["p", "qr", "s"][(n // 3 + 1) % 3], str(n // 3 + 1), f"{'x' * 60}{n // 3 + 1}"][n % 3], None, None)
    assert n == 179_999 and tracemalloc.get_traced_memory()[1] < len(body) / 2
    tracemalloc.stop()
    assert xlsx.read_cells(spark, str(tmp_path)).count() == 180_000

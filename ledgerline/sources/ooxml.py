"""Bytes of .xlsx workbooks, read and written with the standard library in bounded memory."""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: A sheet's limits on lines and on links.
SHEET_ROWS, SHEET_LINKS = 1_048_576, 65_530
#: Lines that say how wide columns are.
WIDTH_ROWS = 1000
_UNWRITABLE = re.compile(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _opened(source) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)


@lru_cache(1 << 15)
def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), s.get("state") or "visible", s.get(f"{_REL}id")) for s in root.iter(f"{_MAIN}sheet")]


def workbook_sheets(source) -> list[tuple[str, str]]:
    """(name, state) of a workbook's sheets, in order; of a file that can seek only two small parts are read."""
    with _opened(source) as z:
        return [(name, state) for name, state, _ in _sheets(z)]


def workbook_cells(source, wanted: Callable[[int, str, str], bool] | None = None, first: int = 1, last: int = SHEET_ROWS) -> Iterator[tuple]:
    """(sheet, state, row, column, value, formula, hyperlink) of every cell with a value, a formula or a link.

    source: a workbook's bytes, or a file that can seek. Only sheets with wanted(position, name, state) are
    opened, and a sheet is left after its line `last`. In memory are one line, the shared strings and the sheet's links.
    """
    with _opened(source) as z:
        names = set(z.namelist())

        def relations(name):
            folder, base = posixpath.split(name)
            rels = f"{folder}/_rels/{base}.rels"
            return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(rels))} if rels in names else {}

        def elements(name, *tags):
            """Elements of a part as they end; the rows or strings that have been read go from memory at once."""
            whole = None
            with z.open(name) as part:
                for event, e in ElementTree.iterparse(part, ("start", "end")):
                    if event == "start":
                        whole = e if e.tag in (f"{_MAIN}sheetData", f"{_MAIN}sst") else whole
                        continue
                    if e.tag in tags:
                        yield e
                    if e.tag in (f"{_MAIN}row", f"{_MAIN}si") and whole is not None:
                        whole.clear()

        strings, targets = None, relations("xl/workbook.xml")
        for position, (sheet, state, rid) in enumerate(_sheets(z)):
            if wanted and not wanted(position, sheet, state):
                continue
            target = targets[rid]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names or last < first:
                continue
            if strings is None:
                strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in elements("xl/sharedStrings.xml", f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
            links = relations(path)
            url = {h.get("ref"): links.get(h.get(f"{_REL}id")) for h in elements(path, f"{_MAIN}hyperlink")} if links else {}
            for c in elements(path, f"{_MAIN}c"):
                ref, kind = c.get("r"), c.get("t")
                letters = ref.rstrip("0123456789")
                row = int(ref[len(letters):])
                if row > last:
                    break
                if row < first:
                    continue
                v, f = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
                value = v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                formula = f"={f.text}" if f is not None and f.text else None
                if value is not None or formula or url.get(ref):
                    yield sheet, state, row, _column(letters), value, formula, url.get(ref)


def _letters(k: int) -> str:
    return (_letters((k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)


def _escaped(t) -> str:
    return _UNWRITABLE.sub("", str(t)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;")


def write_sheet(out, labels: list[str], lines: Iterable, sheet: str = "Sheet1", max_rows: int = SHEET_ROWS - 1) -> int:
    """A workbook of one sheet, written to `out` as its lines arrive; how many lines were taken.

    Lines are tuples as wide as labels. No more are taken than max_rows, or than leave room for one more line of
    links; the rest stays in `lines`, if it is an iterator, for the next workbook. Numbers are numbers, true and false are
    logical values, web addresses are links, all else is text; null, NaN and infinity are empty cells. Characters that XML
    cannot hold are left out. Columns are as wide as the first thousand lines ask for. In memory are those and the links.
    """
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    lines, links, taken = iter(lines), [], 0
    ahead = list(islice(lines, max(1, min(WIDTH_ROWS, max_rows, SHEET_LINKS // max(1, len(labels))))))
    widths = [min(40, max([10, len(str(label)) + 2, *(len(str(v[k])) + 2 for v in ahead if v[k] is not None)])) for k, label in enumerate(labels)]
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))

    columns = [_letters(k) for k in range(1, len(labels) + 1)]

    def line(n, values):
        cells = []
        for letters, v in zip(columns, values, strict=True):
            if v is None or isinstance(v, float) and not math.isfinite(v):
                continue
            ref = f"{letters}{n}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, int | float):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_escaped(v)}</t></is></c>')
                if n > 1 and str(v).startswith(("http://", "https://")):
                    links.append((ref, _escaped(v)))
        return f'<row r="{n}">{"".join(cells)}</row>'.encode()

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="{_escaped(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write(f"<worksheet {ns}><cols>{cols}</cols><sheetData>".encode())
            part.write(line(1, labels))
            rest = chain(ahead, lines)
            while taken < len(ahead) or taken < max_rows and len(links) + len(labels) <= SHEET_LINKS:
                values = next(rest, None)
                if values is None:
                    break
                taken += 1
                part.write(line(taken + 1, values))
            part.write(b"</sheetData>")
            if links:
                part.write("".join(["<hyperlinks>", *(f'<hyperlink ref="{ref}" r:id="rId{k}"/>' for k, (ref, _) in enumerate(links, 1)), "</hyperlinks>"]).encode())
            part.write(b"</worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", "".join([f'<Relationships xmlns="{package}/relationships">', *(f'<Relationship Id="rId{k}" Type="{office}/hyperlink" Target="{url}" TargetMode="External"/>' for k, (_, url) in enumerate(links, 1)), "</Relationships>"]))
    return taken


def write_workbook(rows: list[dict], columns: list[str], labels: list[str], sheet: str = "Sheet1") -> bytes:
    """A workbook of few rows, such as an export a person opens; text as inline strings, links as hyperlinks."""
    out = io.BytesIO()
    write_sheet(out, labels, ([r.get(c) for c in columns] for r in rows), sheet)
    return out.getvalue()

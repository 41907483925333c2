"""Spreadsheets: .xlsx packages and CSV files, as cells, formulas and tables."""

from __future__ import annotations

import csv
import io
import math
import re
from datetime import date, timedelta

from ..functions.numbers import BUILTIN_FORMATS, EPOCH_1900, EPOCH_1904
from . import ir
from .package import Package, attr, local

MAX_DENSE_CELLS = 2_000_000


def col_name(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_ref(ref: str) -> tuple[int, int] | None:
    """A1 to row and column from 0."""
    letters = "".join(c for c in ref.upper() if "A" <= c <= "Z")
    digits = "".join(c for c in ref if c in "0123456789")
    if not letters or not digits or int(digits) == 0:
        return None
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _code_core(code: str) -> str:
    return re.sub(r'\\.|"[^"]*"?|\[[^\]]*\]', "", code.split(";")[0])


def format_hint(fmt: int, code: str | None) -> dict | None:
    dated = 14 <= fmt <= 22 or 45 <= fmt <= 47
    if code is None:
        return {"kind": "date", "time": False, "seconds": False} if dated else None
    core = _code_core(code)
    low = core.lower()
    if dated or re.search("yy|dd|mm/|/mm|m/d|d/m|am/pm|h", low):
        return {"kind": "date", "time": "h" in low or "am/pm" in low, "seconds": "s" in low}
    places = len(m[1]) if (m := re.match(r"[^.]*\.([0#]*)", core)) else 0
    for kind, mark in (("percent", "%"), ("currency", "$")):
        if mark in code:
            return {"kind": kind, "decimals": places, "grouping": "," in code}
    return {"kind": "number", "decimals": places, "grouping": "," in code} if re.search("[0#]", code) else None


def fixed(value: float, decimals: int, grouping: bool) -> str:
    out = f"{abs(value):{',' if grouping else ''}.{decimals}f}"
    return f"-{out}" if math.copysign(1, value) < 0 and out not in ("0", "0.0", "0.00") else out


def serial_text(value: float, time: bool, seconds: bool, uses_1904: bool) -> str:
    day = math.floor(value)
    rest = round((value - day) * 86_400)
    if rest >= 86_400:
        day, rest = day + 1, 0
    try:
        d = date(1970, 1, 1) + timedelta(days=day - (EPOCH_1904 if uses_1904 else EPOCH_1900))
    except OverflowError:
        return str(value)
    out = d.isoformat()
    if time:
        out += f" {rest // 3600:02}:{rest % 3600 // 60:02}" + (f":{rest % 60:02}" if seconds else "")
    return out


class Styles:
    """Shared strings, the number format of each cell style, and the date system."""

    def __init__(self, package: Package) -> None:
        strings = package.xml("xl/sharedStrings.xml")
        self.strings = [] if strings is None else ["".join(t.text or "" for t in _texts(si)) for si in strings if local(si.tag) == "si"]
        codes, self.hints = {}, []
        root = package.xml("xl/styles.xml")
        if root is not None:
            for el in root.iter():
                if local(el.tag) == "numFmt":
                    codes[int(el.get("numFmtId", "0"))] = el.get("formatCode", "")
            for group in root:
                if local(group.tag) == "cellXfs":
                    for xf in group:
                        fmt = int(xf.get("numFmtId", "0"))
                        self.hints.append(format_hint(fmt, codes.get(fmt, BUILTIN_FORMATS.get(fmt))))
        book = package.xml("xl/workbook.xml")
        pr = next((e for e in book.iter() if local(e.tag) == "workbookPr"), None) if book is not None else None
        self.uses_1904 = pr is not None and pr.get("date1904", "").lower() in ("1", "true")

    def show(self, kind: str, style: int | None, raw: str, inline: str, aware: bool) -> str:
        if kind == "inlineStr":
            return inline
        if kind == "s":
            return self.strings[int(raw)] if raw.strip().isdigit() and int(raw) < len(self.strings) else raw
        if kind == "b":
            return "true" if raw.strip() == "1" else "false"
        if kind in ("str", "e") or not raw.strip():
            return raw if raw.strip() else ""
        try:
            value = float(raw.strip())
        except ValueError:
            return raw
        hint = self.hints[style] if style is not None and style < len(self.hints) else None
        if hint is None:
            return raw
        if not aware:
            return "" if hint["kind"] == "date" else raw
        if hint["kind"] == "date":
            return serial_text(value, hint["time"], hint["seconds"], self.uses_1904)
        if hint["kind"] == "percent":
            return fixed(value * 100, hint["decimals"], False) + "%"
        body = fixed(value, hint["decimals"], hint["grouping"])
        if hint["kind"] == "currency":
            return "-$" + body[1:] if body.startswith("-") else "$" + body
        return body


def _texts(el):
    """The text runs of a string item, phonetic ones apart."""
    for child in el:
        if local(child.tag) == "t":
            yield child
        elif local(child.tag) != "rPh":
            yield from _texts(child)


def sheet_parts(package: Package) -> list[tuple[str, str]]:
    book = package.xml("xl/workbook.xml")
    if book is None:
        return []
    rels = {r["id"]: r["target"] for r in package.rels("xl/workbook.xml")}
    out = []
    for el in book.iter():
        if local(el.tag) == "sheet":
            rid = next((v for k, v in el.attrib.items() if k.startswith("{") and local(k) == "id"), None)
            if rid not in rels:
                raise ValueError(f"no relationship for sheet {el.get('name')}")
            out.append((el.get("name", ""), rels[rid]))
    return out


def sheet_names(content: bytes) -> list[str]:
    book = Package(content).xml("xl/workbook.xml")
    return [] if book is None else [e.get("name", "") for e in book.iter() if local(e.tag) == "sheet"]


def sheet_cells(root) -> list[dict]:
    """Cells of a sheet: row and col from 0, kind, style, raw, inline, formula. Places that aren't named follow on."""
    out, row = [], -1
    for data in root:
        if local(data.tag) != "sheetData":
            continue
        for r in data:
            row = int(r.get("r")) - 1 if r.get("r", "").isdigit() else row + 1
            col = -1
            for c in r:
                if local(c.tag) != "c":
                    continue
                at = parse_ref(c.get("r", ""))
                here, col = at if at else (row, col + 1)
                parts = {local(x.tag): x for x in c}
                value = lambda n: "".join(parts[n].itertext()) if n in parts else ""
                inline = "".join(t.text or "" for t in _texts(parts["is"])) if "is" in parts else ""
                style = c.get("s", "")
                out.append({"row": here, "col": col, "kind": c.get("t", "n"), "style": int(style) if style.isdigit() else None, "raw": value("v"), "inline": inline, "formula": value("f") if "f" in parts else None})
    return out


def grid_of(texts: dict[tuple[int, int], str]) -> list[list[str]]:
    """The rectangle of the cells there are; over MAX_DENSE_CELLS only rows and columns with a cell."""
    if not texts:
        return []
    rows, cols = sorted({r for r, _ in texts}), sorted({c for _, c in texts})
    if (rows[-1] - rows[0] + 1) * (cols[-1] - cols[0] + 1) <= MAX_DENSE_CELLS:
        rows, cols = range(rows[0], rows[-1] + 1), range(cols[0], cols[-1] + 1)
    return [[texts.get((r, c), "") for c in cols] for r in rows]


def trim(grid: list[list[str]]) -> list[list[str]]:
    """Without the empty rows and columns at the end; one cell stays."""
    height = max((i + 1 for i, r in enumerate(grid) if any(r)), default=1)
    width = max((j + 1 for r in grid for j, c in enumerate(r) if c), default=1)
    return [r[:width] for r in grid[:height]]


def caption(n: int, grid: list[list[str]]) -> str:
    return f"Table {n} (rows 1–{max(len(grid), 1)}, cols A–{col_name(max(len(grid[0]) if grid else 1, 1))})"


def read_xlsx(content: bytes, style_aware: bool = False, properties: bool = False, sheets: tuple[list[int], list[str]] | None = None, trim_empty: bool = False) -> dict:
    """The document with the tables of its sheets. sheets: numbers and names of those wanted."""
    package = Package(content)
    styles = Styles(package)
    out = []
    for i, (name, part) in enumerate(sheet_parts(package), 1):
        if sheets and (sheets[0] or sheets[1]) and i not in sheets[0] and name not in sheets[1]:
            continue
        texts, formulas = {}, []
        for c in sheet_cells(package.required(part)):
            texts[c["row"], c["col"]] = styles.show(c["kind"], c["style"], c["raw"], c["inline"], style_aware)
            if c["formula"]:
                formulas.append({"cell_ref": f"{col_name(c['col'] + 1)}{c['row'] + 1}", "formula": c["formula"]})
        grid = grid_of(texts) or [[""]]
        grid = trim(grid) if trim_empty else grid
        out.append({"name": name, "tables": [ir.text_table(grid, caption(len(out) + 1, grid))], "formulas": formulas, "hyperlinks": []})
    return ir.document("Xlsx", sheets=out, properties=package.properties(qualified=True, custom=False) if properties else None)


def light_xlsx(content: bytes) -> dict:
    return ir.document("Xlsx", sheets=[{"name": n, "tables": [], "formulas": [], "hyperlinks": []} for n in sheet_names(content)])


def sheet_sizes(content: bytes, sheets: tuple[list[int], list[str]] | None = None) -> list[tuple[str, int, int]]:
    """Name, rows and columns of each sheet: of its dimension, or else of its cells."""
    package = Package(content)
    out = []
    for i, (name, part) in enumerate(sheet_parts(package), 1):
        if sheets and (sheets[0] or sheets[1]) and i not in sheets[0] and name not in sheets[1]:
            continue
        root = package.required(part)
        ref = next((e.get("ref", "") for e in root if local(e.tag) == "dimension"), "")
        a, b = (parse_ref(x) for x in (ref.split(":")[0], ref.split(":")[-1]))
        if a and b:
            out.append((name, abs(b[0] - a[0]) + 1, abs(b[1] - a[1]) + 1))
        else:
            cells = sheet_cells(root)
            out.append((name, max((c["row"] + 1 for c in cells), default=0), max((c["col"] + 1 for c in cells), default=0)))
    return out


def read_csv(content: bytes, delimiter: str = ",", properties: bool = False, trim_empty: bool = False) -> dict:
    if len(delimiter.encode()) != 1:
        raise ValueError("the delimiter is one byte")
    text = content.decode("utf-8-sig", "replace")
    grid = [list(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r] or [[""]]
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    notes = [{"cell_ref": f"{col_name(j + 1)}{i + 1}", "formula": c} for i, r in enumerate(grid) for j, c in enumerate(r) if c.startswith("=")]
    grid = trim(grid) if trim_empty else grid
    props = {"core": {}, "app": {}, "custom": {"source_format": "csv", "delimiter": delimiter}} if properties else None
    return ir.document("Xlsx", sheets=[{"name": "Sheet1", "tables": [ir.text_table(grid, caption(1, grid))], "formulas": notes, "hyperlinks": []}], properties=props)


def light_csv(_content: bytes) -> dict:
    return ir.document("Xlsx", sheets=[{"name": "Sheet1", "tables": [], "formulas": [], "hyperlinks": []}])


__all__ = ["attr", "read_csv", "read_xlsx"]

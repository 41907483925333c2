"""Tables of a page: from tags, rectangles, rules, hints, and from the text alone; and what tells a table from other text.

A table is a dict of columns and rows (their places, rows from top to bottom), cells, items (the indices of those it takes) and
kind, Data or Toc. Rectangles are (x, y, width, height), y upwards. One page at a time."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from .pages import cleaned, cluster_rects, clusters, kept, structure_cells, table_from_lines
from .reading import by_direction, centre, columns as page_columns, effective_width, is_newspaper, is_numeric, line_text, line_up, right, should_join

Cells = list[list[str]]


# ---- numbers in items --------------------------------------------------------------------------------------------------

_DASH = ("—", "–", "-", "‒")


def financial_values(text: str) -> list[str] | None:
    """The values of a text of numbers, dollar amounts and dashes only."""
    out, words = [], text.split()
    k = 0
    while k < len(words):
        if words[k] == "$" and k + 1 < len(words) and _made_of(words[k + 1], ",.()-+%"):
            out.append(f"$ {words[k + 1]}")
            k += 2
        elif _made_of(words[k], ",.()-+%") or words[k] in _DASH:
            out.append(words[k])
            k += 1
        else:
            return None
    return out or None


def split_financial(item: dict) -> list[dict] | None:
    """A wide item (over 20 ems) of three values or more as one item for each, evenly spread; None for any other."""
    if item["width"] <= 20 * item["font_size"] or re.search(r"[^\W\d_]{2}", item["text"]):
        return None
    values = financial_values(item["text"])
    if not values or len(values) < 3:
        return None
    step = item["width"] / len(values)
    return [item | {"text": v, "x": item["x"] + step * (k + 0.5), "width": 0.9 * step} for k, v in enumerate(values)]


def split_numbers(item: dict, bounds: list[float]) -> list[dict]:
    """An item of several words of which the first are numbers ("10 11 12 Holiday") as one item for each number, at column
    bounds that follow each other, and one for the rest at the last number's."""
    words = item["text"].split()
    n = next((k for k, w in enumerate(words) if not (w.isascii() and w.isdigit())), len(words))
    if len(words) < 2 or n == 0:
        return [item]
    step = item["width"] / len(words)
    start = max((k for k, c in enumerate(bounds) if c <= item["x"] + 2), default=0)

    def place(k: int) -> float:
        if start + k < len(bounds):
            return bounds[start + k]
        x = item["x"] + (k + 0.5) * step
        return max((c for c in bounds if c <= x + 2), default=x)

    out = [item | {"text": w, "x": place(k), "width": step} for k, w in enumerate(words[:n])]
    return out + ([item | {"text": " ".join(words[n:]), "x": out[-1]["x"], "width": step}] if n < len(words) else [])


# ---- what cells say ----------------------------------------------------------------------------------------------------


def filled(row: list[str]) -> int:
    return sum(bool(c.strip()) for c in row)


def _number(s: str) -> bool:
    return _made_of(s, ".,-+")


UNITS = ("°", "V", "A", "Hz", "mA", "µ", "pin", "MHz", "kHz")


def is_data(text: str) -> bool:
    """A number, date, part number, or a specification with a unit."""
    s = text.strip()
    if not s:
        return False
    digits = re.search("[0-9]", s) is not None
    short = len(s.encode()) <= 10
    date = short and re.fullmatch(r"[0-9/-]+", s) is not None and re.search("[/-]", s) is not None and len(re.findall("[0-9]", s)) >= 4
    part = short and s.isalnum() and digits
    return _number(s) or date or part or digits and (any(u in s for u in UNITS) or "(" in s and ")" in s) or ("°C" in s or "°F" in s) and "to" in s


def is_key_value(cells: Cells) -> bool:
    """Labels with a value rather than a table: six columns at most, over 70 % of the rows with two filled cells or fewer, and
    over half with a first cell that ends with a colon or is all capitals (over three bytes)."""
    if not cells or len(cells[0]) > 6:
        return False
    label = lambda c: c.endswith(":") or len(c.encode()) > 3 and all(x.isupper() or x.isspace() or x in "()" for x in c)
    two = sum(sum(bool(c) for c in r) <= 2 for r in cells)
    return two > 0.7 * len(cells) and sum(label(r[0].strip()) for r in cells) > 0.5 * len(cells)


def consistent_columns(cells: Cells) -> bool:
    """Whether over 40 % of the rows (three or more) have about as many filled cells as most rows have: two more or fewer; with
    over 15 columns over a quarter of them, a quarter of the columns more or fewer."""
    if len(cells) < 3:
        return True
    counts = Counter(sum(bool(c) for c in r) for r in cells)
    usual = max(counts, key=lambda c: (counts[c], c))
    wide = len(cells[0]) > 15
    near = sum(n for c, n in counts.items() if abs(c - usual) <= (len(cells[0]) // 4 if wide else 2))
    return near > (0.25 if wide else 0.40) * len(cells)


def table_content(cells: Cells, body: bool) -> bool:
    """Whether the rows under the first hold a table's content: three columns or more, or enough data (a fifth; of text of body
    size 30 %), or two columns of cells of 25 bytes on average."""
    own = [c.strip() for r in cells[1:] for c in r if c.strip()]
    if not own:
        return False
    if len(cells[0]) >= 3 or sum(map(is_data, own)) > (0.3 if body else 0.2) * len(own):
        return True
    return len(cells[0]) == 2 and body and sum(len(c.encode()) for c in own) // len(own) <= 25


def _spaced(c: str) -> bool:
    """Letters with a space between each, from the first to the last."""
    return len(c) >= 9 and all((x == " ") == (k % 2 == (c[0] != " ")) and (x == " " or x.isalpha()) for k, x in enumerate(c))


def is_paragraph(cells: Cells) -> bool:
    """Running text in a grid: words cut by hyphens (3 %), mostly empty cells in over ten rows, letter-spaced cells (8 %), or
    many long ones."""
    own = [c.strip() for r in cells for c in r if c.strip()]
    n, total = len(own), sum(map(len, cells))
    if n < 4:
        return False
    cut = sum(len(c) > 1 and c.endswith("-") and c[-2].isalpha() for c in own)
    size = [len(c.encode()) for c in own]
    long = sum(s > 60 for s in size) / n
    empty = len(cells) > 10 and 1 - n / total > 0.55
    return cut > 0.03 * n or empty or sum(map(_spaced, own)) > 0.08 * n or long > 0.3 or long > 0.2 and sum(size) > 40 * n


def _page(cell: str) -> bool:
    """A page number, a list of them, or the number of a page in a section (A-1)."""
    t = cell.strip()
    return re.fullmatch(r"[0-9]{1,4}(, [0-9]{1,4})*|(?=.*[0-9])[0-9A-Z-]+", t) is not None


def _dots(cell: str) -> bool:
    """Three dots or more and nothing else."""
    return cell.count(".") >= 3 and not "".join(cell.split()).strip(".")


def _made_of(text: str, signs: str) -> bool:
    """Digits, one at least, and the signs only."""
    rest = text.translate({ord(c): None for c in signs})
    return rest.isascii() and rest.isdigit()


def _inline_leader(cell: str) -> bool:
    """"label ... 12", or the end of such a text, in one cell."""
    at = cell.find("...")
    if at < 0:
        return False
    before, after = cell[:at], cell[at:].lstrip(".")
    tail = after.strip()
    if before and not before.endswith(" ") or after and not after.startswith(" ") or not tail:
        return False
    return _made_of(tail, ", .$-") and (not before.strip() or any(c.isalpha() for c in before))


def is_leader_index(cells: Cells) -> bool:
    """An index whose cells are whole entries: a quarter of four or more."""
    own = [c.strip() for r in cells for c in r if c.strip()]
    return len(own) >= 4 and 4 * sum(map(_inline_leader, own)) >= len(own)


def _leader_row(row: list[str]) -> bool:
    if not any(map(_page, row)):
        return False
    for k, c in enumerate(x.strip() for x in row):
        if _dots(c) and 2 * c.count(".") > len(c):
            if any(x.isalpha() for left in row[:k] for x in left):
                return True
        elif re.search(r" \.{3,}$", c) and any(x.isalpha() for x in c):
            return True
    return False


_SECTION = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){1,5}\.*")


def is_contents(cells: Cells) -> bool:
    """A table of contents: leader dots in 30 % of the rows or in the cells, or section numbers first in 60 % of four rows or
    more and pages in 70 % of the last cells."""
    if not cells:
        return False
    if sum(map(_leader_row, cells)) >= 0.3 * len(cells) or is_leader_index(cells):
        return True
    if len(cells) < 4 or len(cells[0]) < 2:
        return False
    first = [next((c.split()[0] for c in r if c.strip()), "") for r in cells]
    last = [r[-1].split() for r in cells if r[-1].strip()]
    pages = sum(all(w.isascii() and w.isdigit() for w in x) for x in last)
    return sum(_SECTION.fullmatch(f) is not None for f in first) >= 0.6 * len(cells) and len(last) >= 3 and pages >= 0.7 * len(last)


def kind_of(cells: Cells) -> str:
    return "Toc" if is_contents(cells) else "Data"


def table(columns: list[float], rows: list[float], cells: Cells, items: list[int]) -> dict:
    return {"columns": columns, "rows": rows, "cells": cells, "items": sorted(set(items)), "kind": kind_of(cells)}


def contents_lines(cells: Cells) -> str:
    """A line for each row: what stands in its cells, and after a tab the page in the last one. Leader dots go."""
    page = re.compile(r"([0-9]{1,4}|(?=[A-Z-]*[0-9])(?=.*[A-Z-])[0-9A-Z-]{1,8})")
    out = []
    for row in cells:
        own = [c.strip() for c in row]
        while own and not own[-1]:
            own.pop()
        if not own:
            continue
        last = own.pop() if len(own) > 1 and all(page.fullmatch(w) for w in own[-1].split()) else None
        title = " ".join(c for c in own if c and not _dots(c))
        out.append(title + ("\t" if title and last else "") + (last or ""))
    return "".join(x + "\n" for x in out if x)


def markdown(t: dict) -> str:
    """A compact pipe table with its footnotes below; contents as lines."""
    if not t["cells"] or not t["cells"][0]:
        return ""
    if t["kind"] == "Toc":
        return contents_lines(t["cells"])
    rows, notes = cleaned(t["cells"])
    if not rows:
        return ""
    lines = ["|" + "".join(f"{c}|" for c in r) for r in rows]
    lines.insert(1, "|" + "---|" * len(rows[0]))
    return "".join(x + "\n" for x in [*lines, *([""] if notes else []), *notes])


def is_partial(text: str, layout_known: bool = False) -> bool:
    """Whether a pipe table looks cut wrong: no rule under its first row, a number or empty or equal cells in the header, a first
    row mostly empty, or (four rows or more) three fifths of the cells going on a sentence. layout_known: it is known that
    there is a table, so a number and one empty cell are allowed in the header, and a first row under half empty."""
    lines = [x for x in text.splitlines() if x.startswith("|")]
    if len(lines) < 2:
        return False
    if not re.fullmatch(r"[| -]*", lines[1]):
        return True
    inner = lambda x: [c.strip() for c in x.split("|")][1:-1]
    head, n = inner(lines[0]), len(inner(lines[0]))
    if n < 2:
        return False
    named = [c for c in head if c]
    if not layout_known and re.fullmatch("[0-9]+", head[0]) or n >= 3 and n - len(named) >= (2 if layout_known else 1) or len(set(named)) < len(named):
        return True
    rows = [inner(x) for x in lines[2:]]
    if rows and n >= 3 and rows[0] and sum(not c for c in rows[0]) * (2 if layout_known else 3) >= n:
        return True
    own = [c for r in rows for c in r if c]
    return len(rows) >= 4 and len(own) > 0 and sum(c[0].islower() or c[0] in ",.;)\"'”’" for c in own) >= 0.6 * len(own)


# ---- rows and columns of text ------------------------------------------------------------------------------------------


def row_bounds(items: list[dict]) -> list[float]:
    """Heights of rows from the top: means of clusters of 0.8 x the median size (4 points at least)."""
    if not items:
        return []
    apart = max(0.8 * sorted(i["font_size"] for i in items)[len(items) // 2], 4)
    return [-y for y in clusters([-i["y"] for i in items], apart)]


def _threshold(xs: np.ndarray) -> tuple[float, bool]:
    """The distance that parts columns, and whether it is measured from the last member rather than from the mean."""
    apart = float(np.clip((xs[-1] - xs[0]) / (len(xs) - 1), 25, 50)) if len(xs) > 1 else 50.0
    gaps = np.sort(np.diff(xs))
    gaps = gaps[gaps > 0.1]
    least = min(3, len(gaps) // 2)
    if len(gaps) <= 2:
        return apart, False
    jumps = np.diff(gaps)
    jumps[: max(0, least - 1)] = 0
    jumps[len(jumps) - max(0, least - 1) :] = 0
    k = int(jumps.argmax())
    middle = (gaps[k] + gaps[k + 1]) / 2
    if middle < 15 and jumps[k] > 2 and len(xs) > 500:
        return float(np.clip(middle, 8, 25)), True
    return (max(float(middle), 8.0) if jumps[k] > 10 and middle < apart else apart), False


def column_bounds(items: list[dict], body: bool) -> list[float]:
    """Places of columns: means of clusters of item starts whose distance follows the gaps between them, with items enough. Text
    of body size that stands to over 60 % in one of them has none."""
    if not items:
        return []
    xs = np.sort([i["x"] for i in items])
    apart, edge = _threshold(xs)
    groups: list[list[float]] = []
    for x in xs.tolist():
        if groups and x - (groups[-1][-1] if edge else sum(groups[-1]) / len(groups[-1])) <= apart:
            groups[-1].append(x)
        else:
            groups.append([x])
    near = lambda c: int(np.searchsorted(xs, c + apart)) - int(np.searchsorted(xs, c - apart, "right"))
    cols = [sum(g) / len(g) for g in groups]
    least = max(2, len(items) // max(1, len(cols)) // 4)
    cols = [c for c in cols if near(c) >= least]
    return [] if body and any(near(c) > 0.6 * len(items) for c in cols) else cols


def column_alignment(items: list[dict], cols: list[float], body: bool) -> float:
    """The share of items that start within 30 points (small text: 40) of a column."""
    far = 30 if body else 40
    return sum(any(abs(i["x"] - c) < far for c in cols) for i in items) / len(items) if items else 0.0


def nearest_column(cols: list[float], x: float) -> int | None:
    """The nearest column, within half the least distance between columns, from 25 to 50 points."""
    gaps = [b - a for a, b in zip(cols, cols[1:])]
    far = min(50.0, max(25.0, min(gaps) / 2)) if gaps else 50.0
    k = min(range(len(cols)), key=lambda j: abs(cols[j] - x), default=None)
    return k if k is not None and abs(cols[k] - x) < far else None


def cell_text(items: list[dict]) -> str:
    """The items of a cell in order, joined where they belong to one word."""
    out = ""
    for a, b in zip([None, *items], items):
        raised = a is not None and b["font_size"] < 0.85 * a["font_size"] and abs(a["y"] - b["y"]) > 1
        out += ("" if a is None or raised or should_join(a, b) or out.endswith(" ") else " ") + b["text"].strip()
    return out


def merge_characters(items: list[dict]) -> tuple[list[dict], list[list[int]]]:
    """Single characters that touch as words, and the items of each."""
    out: list[dict] = []
    of: list[list[int]] = []
    for k in sorted(range(len(items)), key=lambda k: (-round(items[k]["y"], 1), items[k]["x"])):
        it = items[k]
        own = out[-1] if out else None
        if own and abs(own["y"] - it["y"]) < 1 and own["font"] == it["font"] and (len(it["text"].strip()) == 1 or len(own["text"].strip()) == 1) and -0.5 * it["font_size"] < it["x"] - right(own) < 0.1 * it["font_size"]:
            own["text"] += it["text"]
            own["width"] = right(it) - own["x"]
            of[-1].append(k)
        else:
            out.append(dict(it))
            of.append([k])
    return out, of


def strict_regions(items: list[dict]) -> list[tuple[float, float]]:
    """Heights between which rows of text line up in columns: runs of three rows or more with two starts or more each, near to
    each other, whose starts are the same by half on average over pairs of rows."""
    rows: list[tuple[float, list[float]]] = []
    for it in items:
        at = next((r for r in rows if abs(it["y"] - r[0]) < 8), None)
        if at is None:
            rows.append((it["y"], [it["x"]]))
        else:
            at[1].append(it["x"])
    starts = sorted((y, np.array(kept(xs, 20))) for y, xs in rows if len(kept(xs, 20)) >= 2)
    if len(starts) < 3:
        return []
    gaps = sorted(b[0] - a[0] for a, b in zip(starts, starts[1:]))
    far = max(25.0, 3 * gaps[len(gaps) // 2])
    runs: list[list] = [[starts[0]]]
    for a, b in zip(starts, starts[1:]):
        if b[0] - a[0] > far:
            runs.append([])
        runs[-1].append(b)
    out = []
    for run in (r for r in runs if len(r) >= 3):
        scores = []
        for k, (_, a) in enumerate(run):
            for _, b in run[k + 1 :]:
                close = np.abs(a[:, None] - b[None, :]) < 10
                scores.append((close.any(1).sum() + close.any(0).sum()) / (2 * max(len(a), len(b))))
        if np.mean(scores) >= 0.5:
            out.append((run[0][0] - 5, run[-1][0] + 5))
    return out


def loose_regions(items: list[dict]) -> list[tuple[float, float]]:
    """Heights between which four items or more stand without a gap of over 30 points."""
    runs: list[list[float]] = []
    for y in sorted(i["y"] for i in items):
        if runs and y - runs[-1][-1] <= 30:
            runs[-1].append(y)
        else:
            runs.append([y])
    return [(r[0] - 5, r[-1] + 5) for r in runs if len(r) >= 4]


def region_table(items: list[dict], index: list[int], body: bool) -> dict | None:
    """The table of a region's items (those of the page at index), if it passes for one."""
    own = [items[k] for k in index]
    cols, rows = column_bounds(own, body), row_bounds(own)
    if not 2 <= len(cols) <= 25 or not 2 <= len(rows) <= 200 or column_alignment(own, cols, body) < (0.7 if body else 0.5):
        return None
    grid: list[list[list[dict]]] = [[[] for _ in cols] for _ in rows]
    taken = []
    nearest = np.abs(np.array(rows)[:, None] - np.array([i["y"] for i in own])).argmin(0).tolist()
    for k, r in zip(index, nearest):
        it = items[k]
        c = nearest_column(cols, it["x"])
        if c is not None and abs(rows[r] - it["y"]) <= 15:
            grid[r][c].append(it)
            taken.append(k)
    cells = [[cell_text(by_direction(c)) for c in r] for r in grid]
    narrow_contents = len(cols) <= 5 and is_contents(cells)
    n, counts = len(rows), [filled(r) for r in cells]
    if sum(bool(r[0]) for r in cells) < n // 4 and not narrow_contents or sum(c >= 2 for c in counts) < max(1, n // (2 if body else 3)):
        return None
    if sum(counts) < 1.5 * n or is_key_value(cells) or not consistent_columns(cells) or not table_content(cells, body):
        return None
    if is_paragraph(cells) and not narrow_contents or is_leader_index(cells):
        return None
    return table(cols, rows, cells, taken)


def recover_header(t: dict, items: list[dict], small: float) -> dict:
    """A table of small text with the row of larger text right above it as its header, if that fills two columns or more."""
    rows = t["rows"]
    far = min(40.0, max(10.0, 2 * (rows[0] - rows[-1]) / (len(rows) - 1))) if len(rows) > 1 else 30.0
    above = [k for k, i in enumerate(items) if i["font_size"] > small and rows[0] < i["y"] <= rows[0] + far]
    if not above:
        return t
    low = min(items[k]["y"] for k in above)
    # rows of larger text from the top, each less than 5 points high; the lowest of them
    tops: list[float] = []
    for y in sorted((items[k]["y"] for k in above), reverse=True):
        if not tops or tops[-1] - y >= 5:
            tops.append(y)
    head = [[] for _ in t["columns"]]
    for k in above:
        c = nearest_column(t["columns"], items[k]["x"])
        if abs(items[k]["y"] - tops[-1]) < 5 and c is not None and items[k]["text"].strip():
            head[c].append(k)
    if sum(map(bool, head)) < 2:
        return t
    cells = [[" ".join(items[k]["text"].strip() for k in c) for c in head], *t["cells"]]
    return table(t["columns"], [max(low, tops[-1]), *rows], cells, t["items"] + [k for c in head for k in c])


def add_labels(t: dict, items: list[dict], candidates: list[int], taken: set[int]) -> dict:
    """A table of two or three columns of numbers (70 % of five rows or more) with the free texts to its left as its first column,
    if two fifths of the rows have one."""
    own = [c for r in t["cells"] for c in r if c.strip()]
    if not 2 <= len(t["columns"]) <= 3 or len(t["rows"]) < 5 or sum(is_numeric({"text": c}) for c in own) < 0.7 * len(own):
        return t
    free = [k for k in candidates if k not in taken and k not in t["items"] and items[k]["x"] < t["columns"][0] - 10]
    labels = [sorted((k for k in free if abs(items[k]["y"] - y) < 5), key=lambda k: items[k]["x"]) for y in t["rows"]]
    if not any(labels) or sum(map(bool, labels)) < len(t["rows"]) * 2 // 5:
        return t
    cells = [[" ".join(items[k]["text"] for k in ks), *r] for ks, r in zip(labels, t["cells"])]
    return table([min(items[k]["x"] for ks in labels for k in ks), *t["columns"]], t["rows"], cells, t["items"] + [k for ks in labels for k in ks])


def text_tables(items: list[dict], base: float, skip_body: bool = False) -> list[dict]:
    """Tables without rules: first of text smaller than 0.9 x the body size, then of body size in stricter regions."""
    if len(items) < 6:
        return []
    merged, of = merge_characters(items)
    own, source = [], []
    for it, ks in zip(merged, of):
        for part in split_financial(it) or [it]:
            own.append(part)
            source.append(ks)
    out, taken = [], set()
    small = [k for k, i in enumerate(own) if 6 <= i["font_size"] <= 0.9 * base]
    for lo, hi in loose_regions([own[k] for k in small]) if len(small) >= 6 else []:
        inside = [k for k in small if lo <= own[k]["y"] <= hi]
        t = region_table(own, inside, False) if len(inside) >= 6 else None
        if t:
            t = add_labels(recover_header(t, own, 0.9 * base), own, inside, taken)
            taken.update(t["items"])
            out.append(t)
    body = [] if skip_body else [k for k, i in enumerate(own) if k not in taken and max(6, 0.85 * base) <= i["font_size"] <= 1.05 * base]
    for lo, hi in strict_regions([own[k] for k in body]) if len(body) >= 6 else []:
        inside = [k for k in body if lo <= own[k]["y"] <= hi]
        t = region_table(own, inside, True) if len(inside) >= 6 else None
        if t:
            out.append(t)
    return [t | {"items": sorted({j for k in t["items"] for j in source[k]})} for t in out]


# ---- grids of rectangles -----------------------------------------------------------------------------------------------

Rect = tuple[float, float, float, float]


def assign(items: list[dict], col_edges: list[float], row_edges: list[float], slack: float = 2.0) -> tuple[Cells, list[int]]:
    """Items in the first column that holds their centre and the first row that holds their baseline, within 2 points; the text
    of a cell from the top, left to right."""
    cells: list[list[list[int]]] = [[[] for _ in col_edges[1:]] for _ in row_edges[1:]]
    taken = []
    for k, it in enumerate(items):
        c = next((j for j, (a, b) in enumerate(zip(col_edges, col_edges[1:])) if a - slack <= centre(it) <= b + slack), None)
        r = next((j for j, (a, b) in enumerate(zip(row_edges, row_edges[1:])) if b - slack <= it["y"] <= a + slack), None)
        if c is not None and r is not None:
            cells[r][c].append(k)
            taken.append(k)
    text = lambda ks: " ".join(items[k]["text"].strip() for k in sorted(ks, key=lambda k: (-items[k]["y"], items[k]["x"])))
    return [[text(c) for c in r] for r in cells], taken


def merged_cells(cells: Cells, col_edges: list[float], row_edges: list[float], rects: list[Rect], slack: float = 6.0) -> Cells:
    """Cells over which one rectangle spans several rows as one: their text in the first row."""
    out = [list(r) for r in cells]
    for c, (a, b) in enumerate(zip(col_edges, col_edges[1:])):
        for x, y, w, h in rects:
            if x > a + slack or x + w < b - slack:
                continue
            over = [r for r, (top, low) in enumerate(zip(row_edges, row_edges[1:])) if min(top, y + h) - max(low, y) > slack]
            if len(over) > 1:
                rows = range(over[0], over[-1] + 1)
                whole = " ".join(t for r in rows if (t := out[r][c].strip()))
                for r in rows:
                    out[r][c] = whole if r == over[0] else ""
    return out


def _trimmed(cols: list[float], cells: Cells) -> tuple[list[float], Cells] | None:
    """Without empty columns at the sides; None if one inside is empty or fewer than two are left."""
    full = [any(r[c].strip() for r in cells) for c in range(len(cols))]
    if sum(full) < 2:
        return None
    a, b = full.index(True), len(full) - full[::-1].index(True)
    return (cols[a:b], [r[a:b] for r in cells]) if all(full[a:b]) else None


def _middles(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def grid_table(items: list[dict], rects: list[Rect], skip: list[bool] | None = None, strict: bool = False, least: int = 3) -> dict | None:
    """A table whose cells rectangles draw: edges snapped to 6 points, two columns and `least` rows or more, 30 % of the cells
    backed by a rectangle, a quarter of them filled (strict: 40 %, half of the rows, no cell over 200 bytes). skip: page
    backgrounds, whose sides are no edges."""
    skip = skip or [False] * len(rects)
    xs = kept([e for (x, _, w, _), s in zip(rects, skip) if not s for e in (x, x + w)], 6.0)
    ys = kept([e for _, y, _, h in rects for e in (y, y + h)], 6.0)[::-1]
    if not 3 <= len(xs) <= 26 or len(ys) <= least:
        return None
    r = np.array(rects)
    across = (r[:, 0] <= np.array(xs[:-1])[:, None] + 6) & (r[:, 0] + r[:, 2] >= np.array(xs[1:])[:, None] - 6)
    down = (r[:, 1] <= np.array(ys[:-1])[:, None] + 6) & (r[:, 1] + r[:, 3] >= np.array(ys[1:])[:, None] - 6)
    total = (len(xs) - 1) * (len(ys) - 1)
    if ((down.astype(np.float32) @ across.T.astype(np.float32)) > 0).sum() < 0.3 * total:
        return None
    cells, taken = assign(items, xs, ys)
    if len(xs) <= 11:
        cells = merged_cells(cells, xs, ys, [x for x, s in zip(rects, skip) if not s])
    counts = [filled(x) for x in cells]
    if not taken or sum(map(bool, counts)) < (len(cells) // 2 if strict else 2) or sum(counts) < (0.4 if strict else 0.25) * total:
        return None
    if strict and max(len(c.encode()) for x in cells for c in x) > 200:
        return None
    cut = _trimmed(_middles(xs), cells)
    return table(cut[0], _middles(ys), cut[1], taken) if cut else None


def backgrounds(rects: list[Rect]) -> list[bool]:
    """Which rectangles lie at the origin and are 20 x as high as the median one."""
    high = 20 * sorted(r[3] for r in rects)[len(rects) // 2] if rects else 0
    return [x < 5 and y < 5 and h > high for x, y, _, h in rects]


def group_table(items: list[dict], rects: list[Rect]) -> dict | None:
    """The grid of a group of rectangles, again strictly without the page's background where that has one."""
    t = grid_table(items, rects)
    if t is None and any(backgrounds(rects)):
        t = grid_table(items, rects, backgrounds(rects), True)
    return t


def stripe_table(items: list[dict], rects: list[Rect], any_shape: bool = False) -> dict | None:
    """A table of shaded rows: rectangles over 200 points wide, three quarters of them of one width, whose edges are the rows;
    columns by the starts of the text. any_shape: of rectangles that are cells, too."""
    widths = sorted(r[2] for r in rects)
    usual = widths[len(widths) // 2] if widths else 0.0
    if not any_shape and (len(rects) < 3 or usual <= 200 or sum(abs(w - usual) <= 0.1 * usual for w in widths) <= 0.75 * len(rects)):
        return None
    ys = kept([e for _, y, _, h in rects for e in (y, y + h)], 6.0)[::-1]
    lo, hi = min((r[0] for r in rects), default=0), max((r[0] + r[2] for r in rects), default=0)
    inside = [i for i in items if ys and ys[-1] - 2 <= i["y"] <= ys[0] + 2 and i["x"] >= lo - 5 and i["x"] + i["width"] <= hi + 5]
    if len(ys) < 4 or not inside:
        return None
    cols = clusters([i["x"] for i in inside], 15.0)
    if not 2 <= len(cols) <= 25:
        return None
    edges = [min(i["x"] for i in inside) - 5, *_middles(cols), max(i["x"] + i["width"] for i in inside) + 5]
    cells, taken = assign(items, edges, ys)
    counts = [filled(r) for r in cells]
    if not taken or sum(map(bool, counts)) < 2 or sum(counts) < 0.4 * len(cols) * len(cells):
        return None
    if max(len(c.encode()) for r in cells for c in r) > (2000 if len(cols) >= 3 else 500):
        return None
    cut = _trimmed(_middles(edges), cells)
    return table(cut[0], _middles(ys), cut[1], taken) if cut else None


def _box(rects: list[Rect]) -> tuple[float, float, float, float]:
    """Left, right, bottom and top of them all."""
    return min(r[0] for r in rects), max(r[0] + r[2] for r in rects), min(r[1] for r in rects), max(r[1] + r[3] for r in rects)


def split_wide(rects: list[Rect], gap: float = 15.0, least: int = 6) -> tuple[list[Rect], list[Rect]] | None:
    """A group in two at its widest gap from left to right, of `gap` points or more, with so many rectangles on both sides."""
    order = sorted(rects)
    ends = np.maximum.accumulate([r[0] + r[2] for r in order])[:-1] if len(order) > 1 else np.zeros(0)
    gaps = np.array([r[0] for r in order])[1:] - ends
    if not len(gaps) or gaps.max() < gap:
        return None
    k = int(gaps.argmax()) + 1
    return (order[:k], order[k:]) if min(k, len(order) - k) >= least else None


def usable(rects: list[Rect]) -> list[Rect]:
    """Rectangles of 5 points or more each way, not ten times as wide as the median one, nor inside a cell not much larger."""
    own = [(min(x, x + w), min(y, y + h), abs(w), abs(h)) for x, y, w, h in rects if min(abs(w), abs(h)) >= 5]
    if len(own) < 6:
        return own
    most = 10 * sorted(r[2] for r in own)[len(own) // 2]
    own = [r for r in own if r[2] <= most]
    a = np.array(own).reshape(-1, 4)
    out = []
    for x, y, w, h in own:
        holds = (a[:, 2] * a[:, 3] > 1.2 * w * h) & (a[:, 3] < 4 * h) & (a[:, 0] <= x + 2) & (a[:, 0] + a[:, 2] >= x + w - 2) & (a[:, 1] <= y + 2) & (a[:, 1] + a[:, 3] >= y + h - 2)
        if not holds.any():
            out.append((x, y, w, h))
    return out


def rect_tables(items: list[dict], rects: list[Rect]) -> tuple[list[dict], list[dict]]:
    """Tables that rectangles draw, and, if there are none, hints (left, right, bottom, top, rects): where groups of them
    suggest one.

    Each group of touching rectangles (six or more) is tried as a grid, as shaded rows, and in two halves; then all groups
    together as shaded rows, if that gave narrow tables only; then their cells as rows; then, without groups, all."""
    own = usable(rects)
    tables, failed, groups = [], [], []
    if len(own) >= 6:
        bg = backgrounds(own)
        fore = [r for r, b in zip(own, bg) if not b]
        groups = [[fore[k] for k in g] for g in cluster_rects(fore, 3.0, 6)]
        for g in groups:
            t = group_table(items, g) or stripe_table(items, g)
            halves = None if t else split_wide(g)
            found = [t] if t else [x for half in halves or () if (x := group_table(items, half) or stripe_table(items, half))]
            tables += found
            if not found:
                failed.append(g)
        if all(len(t["columns"]) <= 3 for t in tables) and len(groups) >= 3 and sum(map(len, groups)) >= 50:
            t = stripe_table(items, [r for g in groups for r in g], True)
            if t and len(t["columns"]) > 3:
                tables = [t]
        if not tables:
            tables = [t for g in failed if (t := stripe_table(items, g, True)) and len(t["columns"]) >= 3]
        if not tables and not groups and len(own) >= 15:
            t = stripe_table(items, own)
            tables = [t] if t and len(t["rows"]) >= 10 else []
    return (tables, []) if tables else ([], hints(items, own, failed))


def continued_grid(items: list[dict], rects: list[Rect], before: dict) -> list[dict]:
    """The end of the table of the page before, where it is a grid of two rows, which is none by itself: the columns of that
    table at the same places, its header again, and a row."""
    own = usable(rects)
    made = [grid_table(items, [own[k] for k in g], least=2) for g in cluster_rects(own, 3.0, 4)]
    same = lambda t: len(t["columns"]) == len(before["columns"]) and all(abs(a - b) <= 6 for a, b in zip(t["columns"], before["columns"]))
    return [t for t in made if t and len(t["rows"]) == 2 and same(t) and t["cells"][0] == before["cells"][0]]


def hints(items: list[dict], rects: list[Rect], failed: list[list[Rect]]) -> list[dict]:
    """Where groups of rectangles that are no grid suggest a table: large ones (30 or more) of moderate size, two or more of
    them; and failed ones of 100 to 600 points height with six items or more inside. On pages of four to six rectangles
    their group."""
    named = lambda g: dict(zip(("left", "right", "bottom", "top"), _box(g))) | {"rects": g}
    out = []
    if len(rects) >= 6:
        large = [named([rects[k] for k in g]) for g in cluster_rects(rects, 3.0, 6) if len(g) >= 30]
        out = [h for h in large if 30 <= h["right"] - h["left"] <= 400 and 10 <= h["top"] - h["bottom"] <= 400]
        sure = []
        for g in failed:
            h = named(g)
            wide = h["right"] - h["left"] <= (800 if len(g) >= 30 else 500)
            if wide and 100 <= h["top"] - h["bottom"] <= 600 and len(inside_hint(items, h)) >= 6:
                sure.append(h)
        out = _apart(out + sure)
        if len(out) < 2 and not sure:
            out = []
    if not out and 4 <= len(rects) <= 6:
        out = [named([rects[k] for k in g]) for g in cluster_rects(rects, 3.0, 4)]
    return out


def _apart(found: list[dict]) -> list[dict]:
    """Hints that overlap as one."""
    out: list[dict] = []
    for h in found:
        at = next((o for o in out if min(o["right"], h["right"]) > max(o["left"], h["left"]) and min(o["top"], h["top"]) > max(o["bottom"], h["bottom"])), None)
        if at is None:
            out.append(dict(h))
        else:
            at.update(left=min(at["left"], h["left"]), right=max(at["right"], h["right"]), bottom=min(at["bottom"], h["bottom"]), top=max(at["top"], h["top"]), rects=at["rects"] + [r for r in h["rects"] if r not in at["rects"]])
    return out


def inside_hint(items: list[dict], h: dict, pad: float = 15.0, whole_width: bool = False) -> list[int]:
    return [k for k, i in enumerate(items) if h["bottom"] - pad <= i["y"] <= h["top"] + pad and (whole_width or h["left"] - pad <= i["x"] <= h["right"] + pad)]


def hint_bands(items: list[dict], rects: list[Rect]) -> list[tuple[float, float]]:
    """Left and right half of a page on which groups of 30 rectangles or more stand in pairs, left and right of the middle at
    one height (three pairs or more). Empty otherwise."""
    own = [(min(x, x + w), min(y, y + h), abs(w), abs(h)) for x, y, w, h in rects if min(abs(w), abs(h)) >= 5]
    if len(own) < 60 or not items:
        return []
    most = 10 * sorted(r[2] for r in own)[len(own) // 2]
    own = [r for r in own if r[2] <= most]
    groups = cluster_rects(own, 3.0, 6)
    boxes = [_box([own[k] for k in g]) for g in groups if len(g) >= 30]
    boxes = [b for b in boxes if 30 <= b[1] - b[0] <= 400 and 10 <= b[3] - b[2] <= 400]
    if len(groups) < 4 or len(boxes) < 4:
        return []
    lo, hi = min(i["x"] for i in items), max(i["x"] + i["width"] for i in items)
    is_left = [(b[0] + b[1]) / 2 < (lo + hi) / 2 for b in boxes]
    pairs = sum(min(a[3], b[3]) - max(a[2], b[2]) > 0.5 * min(a[3] - a[2], b[3] - b[2]) for j, a in enumerate(boxes) for k, b in enumerate(boxes) if is_left[j] and not is_left[k])
    if pairs < 3:
        return []
    x = (max(b[1] for b, s in zip(boxes, is_left) if s) + min(b[0] for b, s in zip(boxes, is_left) if not s)) / 2
    return [(lo, x), (x, hi)]


def guided_table(items: list[dict], rects: list[Rect]) -> dict | None:
    """A calendar-like table: columns at the left sides of rectangles (five or more, gaps of 1.5 x the median filled evenly),
    rows by the text, numbers that stand together dealt out; one row must fill five cells."""
    bounds: list[float] = []
    for x in sorted(r[0] for r in rects):
        if not bounds or x - bounds[-1] > 2:
            bounds.append(x)
    if not items or len(bounds) < 5:
        return None
    steps = sorted(b - a for a, b in zip(bounds, bounds[1:]))
    usual = steps[len(steps) // 2]
    cols = [bounds[0]]
    for a, b in zip(bounds, bounds[1:]):
        n = round((b - a) / usual) if b - a > 1.5 * usual else 1
        cols += [a + (b - a) * k / max(n, 1) for k in range(1, n)] + [b]
    parts = [(p, k) for k, i in enumerate(items) for p in split_numbers(i, cols)]
    rows: list[float] = []
    for y in sorted((p["y"] for p, _ in parts), reverse=True):
        if not rows or rows[-1] - y > 5:
            rows.append(y)
    cells: list[list[list[str]]] = [[[] for _ in cols] for _ in rows]
    taken = []
    most = cols[-1] + 1.5 * (cols[-1] - cols[0]) / (len(cols) - 1)
    for p, k in parts:
        c = max((j for j, x in enumerate(cols) if p["x"] >= x - 4), default=None)
        r = next(j for j, y in enumerate(rows) if abs(y - p["y"]) <= 5)
        if c is not None and p["x"] <= most:
            cells[r][c].append(p["text"].strip())
            taken.append(k)
    text = [[t.split("~~~")[0].rstrip() if "~~~" in (t := " ".join(c)) else t for c in r] for r in cells]
    return table(cols, rows, text, taken) if max(sum(bool(c) for c in r) for r in text) >= 5 else None


def column_table(items: list[dict]) -> dict | None:
    """A table without rules on a page of four layout columns or more that isn't read column by column: 3 to 40 rows, half of
    them with two cells or more, short cells, no sentences, no column with over 60 %."""
    cols = page_columns(items)
    if len(cols) < 4:
        return None
    tops: list[float] = []
    for y in sorted((i["y"] for i in items), reverse=True):
        if not tops or tops[-1] - y >= 3:
            tops.append(y)
    for y in tops[:5]:  # a header with two items in one column parts that
        row = [i for i in items if abs(i["y"] - y) < 3]
        pairs = [sorted((i["x"], i["width"]) for i in row if a <= i["x"] < b)[:2] for a, b in cols]
        if len(row) >= len(cols) and any(len(p) == 2 for p in pairs):
            middles = [(sum(p[0]) + p[1][0]) / 2 if len(p) == 2 else None for p in pairs]
            cols = [part for (a, b), m in zip(cols, middles) for part in ([(a, b)] if m is None else [(a, m), (m, b)])]
            break
    over = [[max(0.0, min(i["x"] + i["width"], b) - max(i["x"], a)) for a, b in cols] for i in items]
    one = [sum(o > 0 for o in os) <= 1 for os in over]
    place = [os.index(max(os)) for os in over]
    buckets = [[i for i, ok, p in zip(items, one, place) if ok and p == c] for c in range(len(cols))]
    lines = [line_up(b) for b in buckets]
    if is_newspaper(lines, cols):
        return None
    rows: list[float] = []
    for x in (x for ls in lines for x in ls):
        if not any(abs(r - x["y"]) < 5 for r in rows):
            rows.append(x["y"])
    rows.sort(reverse=True)
    if not 3 <= len(rows) <= 40:
        return None
    cells: list[list[list[str]]] = [[[] for _ in cols] for _ in rows]
    taken = []
    for k, (i, ok, p) in enumerate(zip(items, one, place)):
        r = next((j for j, y in enumerate(rows) if abs(y - i["y"]) < 5), None)
        if ok and over[k][p] > 0 and r is not None:
            cells[r][p].append(i["text"])
            taken.append(k)
    text = [[" ".join(c) for c in r] for r in cells]
    own = [c.strip() for r in text for c in r if c.strip()]
    size = [len(c.encode()) for c in own]
    if len(own) < 0.15 * len(rows) * len(cols) or not own or 2 * sum(filled(r) >= 2 for r in text) < len(rows):
        return None
    if sum(size) > 40 * len(own) or sum(s > 80 for s in size) > 0.1 * len(own) or sum(len(c.encode()) > 20 and c[-1] in ".!?:" for c in own) > 0.15 * len(own):
        return None
    if max(sum(bool(r[c].strip()) for r in text) for c in range(len(cols))) > 0.6 * len(own):
        return None
    return table([a for a, _ in cols], rows, text, taken)


def rule_table(items: list[dict], segments: list[tuple]) -> dict | None:
    """The table that horizontal and vertical rules draw; it must hold a fifth of the items."""
    cells = table_from_lines(items, segments)
    if cells is None:
        return None
    xs = kept([s[0] for s in segments if abs(s[0] - s[2]) <= 1 and abs(s[1] - s[3]) > 5], 6.0)
    ys = kept([s[1] for s in segments if abs(s[1] - s[3]) <= 1 and abs(s[0] - s[2]) > 5], 6.0)[::-1]
    _, taken = assign(items, xs, ys)
    return table(_middles(xs), _middles(ys), cells, taken) if len(taken) >= 0.2 * len(items) else None


def tagged_tables(items: list[dict], tables: list[list[list[dict]]], page: int) -> list[dict]:
    """Tables of the tag tree (rows of cells {header, mcids: (id, page)}) with the page's items that have their ids: two rows
    and columns or more, 30 % of the cells found. Cells stand in the columns of the widest row, by where their text starts."""
    by_id: dict[int, list[int]] = {}
    for k, i in enumerate(items):
        if i.get("mcid") is not None:
            by_id.setdefault(i["mcid"], []).append(k)
    out = []
    for rows in tables:
        own = [r for r in rows if any(p == page for c in r for _, p in c["mcids"])]
        n = max(map(len, own), default=0)
        if len(own) < 2 or n < 2:
            continue
        found = [[sorted((k for m, p in c["mcids"] if p == page for k in by_id.get(m, ())), key=lambda k: (-items[k]["y"], items[k]["x"])) for c in r] for r in own]
        if sum(bool(c) for r in found for c in r) < 0.3 * sum(map(len, found)):
            continue
        full = [r for r in found if len(r) == n and all(r)]
        cols = [min(items[k]["x"] for r in full for k in r[c]) for c in range(n)] if full else [float(c) for c in range(n)]
        cells, taken, ys = [], [], []
        for r in found:
            line, at = [""] * n, -1
            for j, c in enumerate(r):
                x = min((items[k]["x"] for k in c), default=None)
                # a row of fewer cells: each goes to the nearest column that leaves room for those after it
                free = range(at + 1, n - (len(r) - j - 1))
                at = j if len(r) == n or x is None or not full else min(free, key=lambda q: abs(cols[q] - x))
                line[at] = " ".join(items[k]["text"].strip() for k in c)
                taken += c
            cells.append(line)
            ys.append(max((items[k]["y"] for c in r for k in c), default=0.0))
        out.append(table(cols, ys, cells, taken))
    return out


# ---- cells that a model of table structure names -----------------------------------------------------------------------


def structured(tokens: list[str], boxes: list[list[float]], dpi: float, origin: tuple[float, float]) -> list[dict]:
    """Cells (row, col, rowspan, colspan, header, text, box) of structure tokens; boxes are polygons or corners in pixels of an
    image of the region, box in points of the page, y downwards."""
    head, cells = False, []
    slots = iter(structure_cells([t for t in tokens]))
    rows_in_head: set[int] = set()
    row = -1
    for t in tokens:
        head = t == "<thead>" or head and t != "</thead>"
        row += t == "<tr>"
        if head:
            rows_in_head.add(max(row, 0))
    for k, s in enumerate(slots):
        box = (0.0, 0.0, 0.0, 0.0)
        if k < len(boxes) and len(boxes[k]) >= 4:
            b = boxes[k]
            xs, ys = b[0::2], b[1::2]
            scale = 72.0 / dpi
            box = (min(xs) * scale + origin[0], min(ys) * scale + origin[1], max(xs) * scale + origin[0], max(ys) * scale + origin[1])
        cells.append(s | {"header": s["row"] in rows_in_head, "text": "", "box": box})
    return separate_bands(cells)


def _axis_bands(cells: list[dict], at: str, span: str, lo: int) -> dict[int, tuple[float, float]]:
    spans: dict[int, list[tuple[float, float]]] = {}
    for c in sorted(cells, key=lambda c: c[span] > 1):
        a, b = sorted((c["box"][lo], c["box"][lo + 2]))
        if a < b and (c[span] <= 1 or c[at] not in spans):
            spans.setdefault(c[at], []).append((a, b))
    order = sorted(spans)
    middle = {k: sum(a + b for a, b in spans[k]) / 2 / len(spans[k]) for k in order}
    out = {}
    for j, k in enumerate(order):
        a = (middle[order[j - 1]] + middle[k]) / 2 if j else min(x for x, _ in spans[k])
        b = (middle[order[j + 1]] + middle[k]) / 2 if j + 1 < len(order) else max(x for _, x in spans[k])
        if a < b:
            out[k] = (a, b)
    return out


def separate_bands(cells: list[dict]) -> list[dict]:
    """Boxes cut to bands of rows and columns that don't overlap: each up to the middle between its neighbours' centres."""
    if len(cells) < 2:
        return cells
    rows, cols = _axis_bands(cells, "row", "rowspan", 1), _axis_bands(cells, "col", "colspan", 0)
    out = []
    for c in cells:
        box = list(c["box"])
        for bands, first, span, lo in ((rows, c["row"], c["rowspan"], 1), (cols, c["col"], c["colspan"], 0)):
            last = first + max(1, span) - 1
            if first in bands and last in bands:
                a, b = max(box[lo], bands[first][0]), min(box[lo + 2], bands[last][1])
                if a < b:
                    box[lo], box[lo + 2] = a, b
        out.append(c | {"box": tuple(box)})
    return out


def is_rotated(items: list[dict]) -> bool:
    """Whether most items lie below the page, as those of a page turned upright do."""
    return bool(items) and 2 * sum(i["y"] < 0 for i in items) >= len(items)


def bounds(box: tuple, height: float, rotated: bool = False) -> tuple[float, float, float, float]:
    """Left, bottom, right and top of a box (y downwards) in the coordinates of the items."""
    (x1, x2), (y1, y2) = sorted((box[0], box[2])), sorted((box[1], box[3]))
    return (height - y2, -x2, height - y1, -x1) if rotated else (x1, height - y2, x2, height - y1)


def _high(item: dict) -> float:
    return item.get("height", item["font_size"])


def in_region(item: dict, b: tuple, margin: float = 1.5) -> bool:
    """Whether an item overlaps a region widened by the margin."""
    return min(right(item), b[2] + margin) > max(item["x"], b[0] - margin) and min(item["y"] + _high(item), b[3] + margin) > max(item["y"], b[1] - margin)


def _belongs(item: dict, b: tuple) -> bool:
    """Its centre inside, or three fifths of it both ways."""
    w, h = effective_width(item), _high(item)
    cx, cy = item["x"] + w / 2, item["y"] + h / 2
    over = lambda a, n, lo, hi: (min(a + n, hi) - max(a, lo)) / n if n > 0 else 0.0
    return b[0] <= cx <= b[2] and b[1] <= cy <= b[3] or over(item["x"], w, b[0], b[2]) >= 0.6 and over(item["y"], h, b[1], b[3]) >= 0.6


def fill_cells(cells: list[dict], items: list[dict], height: float, threshold: float = 0.10) -> list[dict]:
    """Cells with the page's text: each item in the cell it belongs to whose centre is nearest; what belongs to none goes to the
    nearest cell that is still empty, within half a usual cell, items of one line together."""
    turned = is_rotated(items)
    area = [bounds(c["box"], height, turned) if c["box"][0] < c["box"][2] and c["box"][1] < c["box"][3] else None for c in cells]
    inside: list[list[dict]] = [[] for _ in cells]
    orphans = []
    for it in items:
        cx, cy = centre(it), it["y"] + _high(it) / 2
        near = [(((b[0] + b[2]) / 2 - cx) ** 2 + ((b[1] + b[3]) / 2 - cy) ** 2, k) for k, b in enumerate(area) if b and _belongs(it, b)]
        if near:
            inside[min(near)[1]].append(it)
        elif it["text"].strip():
            orphans.append(it)
    text = [" ".join(x["text"].strip() for x in line_up(sorted(c, key=lambda i: (-i["y"], i["x"])), threshold)) for c in inside]
    sized = [b for b in area if b]
    if sized and orphans:
        far_x, far_y = (float(np.median([b[k + 2] - b[k] for b in sized])) / 2 for k in (0, 1))
        first: dict[int, float] = {}
        empty = [k for k, t in enumerate(text) if not t and area[k]]
        for it in orphans:
            cx, cy = centre(it), it["y"] + _high(it) / 2
            best = None
            for k in empty:
                b = area[k]
                dx, dy = max(b[0] - cx, 0, cx - b[2]), max(b[1] - cy, 0, cy - b[3])
                if dx <= far_x and dy <= far_y and abs(first.get(k, cy) - cy) <= max(3.0, far_y / 2) and (best is None or dx * dx + dy * dy < best[0]):
                    best = (dx * dx + dy * dy, k)
            if best:
                k = best[1]
                text[k] = f"{text[k]} {it['text'].strip()}".strip()
                first.setdefault(k, cy)
    return [c | {"text": t} for c, t in zip(cells, text)]


def structure_issue(cells: list[dict], items: list[dict], height: float) -> str | None:
    """What is wrong with the cells of a model: an empty row between filled ones, or text of several lines in a cell of one row."""
    most = max((c["row"] for c in cells), default=0)
    full = {c["row"] for c in cells if c["text"].strip()}
    if any(r not in full and {r - 1, r + 1} <= full for r in range(1, most)):
        return "phantom_empty_row"
    turned = is_rotated(items)
    for c in cells:
        if c["rowspan"] > 1 or not c["text"].strip() or c["box"][0] >= c["box"][2] or c["box"][1] >= c["box"][3]:
            continue
        b = bounds(c["box"], height, turned)
        own = sorted(((i["y"] + _high(i) / 2, max(_high(i) / 2, 2.5)) for i in items if _belongs(i, b)), key=lambda x: -x[0])
        apart = max([2.5, *(h for _, h in own)])
        if any((ya - ha) - (yb + hb) > apart for (ya, ha), (yb, hb) in zip(own, own[1:])):
            return "multi_row_in_cell"
    return None


def cells_markdown(cells: list[dict]) -> str:
    """A pipe table of placed cells: the text of a span in its first place, the rule after the last header row, or the first."""
    if not cells:
        return ""
    rows, cols = max(c["row"] + max(1, c["rowspan"]) for c in cells), max(c["col"] + max(1, c["colspan"]) for c in cells)
    grid = [[""] * cols for _ in range(rows)]
    for c in cells:
        grid[c["row"]][c["col"]] = re.sub(r"[ \t\r\n]+", " ", c["text"]).strip().replace("|", "\\|")
    head = max((c["row"] for c in cells if c.get("header")), default=0)
    lines = ["|" + "".join(f"{c}|" for c in r) for r in grid]
    lines.insert(head + 1, "|" + "---|" * cols)
    return "".join(x + "\n" for x in lines)


def region_text(items: list[dict], box: tuple, height: float, threshold: float = 0.10) -> str:
    """The text of the items that overlap a box (y downwards), in lines."""
    b = bounds(box, height, is_rotated(items))
    own = [i for i in items if in_region(i, b)]
    return "\n".join(line_text(x["items"], threshold) for x in line_up(sorted(own, key=lambda i: (-i["y"], i["x"])), threshold))


def region_items(items: list[dict], box: tuple, height: float) -> list[dict]:
    b = bounds(box, height, is_rotated(items))
    return [i for i in items if in_region(i, b)]

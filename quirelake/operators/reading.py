"""Reading order of a page: items joined to words and lines, columns, headings, alignment.

A page is a list of items: dicts of text, x, y, width, font, font_size and, where known, bold, italic and mcid. What is decided
here depends on the item before, so it runs on one page at a time; `reading_lines` is its DataFrame form."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TIGHT = 0.10  # of the font size: the gap between glyphs below which single characters are one word
NOWHERE = float("inf")


def effective_font_size(size: float, matrix: tuple) -> float:
    """The size that a text matrix (a, b, c, d, x, y) gives: the larger of both scales."""
    a, b, c, d, *_ = matrix
    return size * max((a * a + b * b) ** 0.5, (c * c + d * d) ** 0.5)


def effective_width(item: dict) -> float:
    """The width, or half an em for each character where the font has none."""
    return item["width"] if item["width"] > 0 else len(item["text"]) * item["font_size"] * 0.5


def right(item: dict) -> float:
    return item["x"] + effective_width(item)


def centre(item: dict) -> float:
    return item["x"] + effective_width(item) / 2


def is_cjk(c: str) -> bool:
    """Fixed ranges: CJK symbols and kana, ideographs, Hangul, compatibility forms."""
    n = ord(c) if c else 0
    return 0x3000 <= n <= 0x30FF or 0x3400 <= n <= 0x4DBF or 0x4E00 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7AF or 0xF900 <= n <= 0xFAFF or 0xFF00 <= n <= 0xFFEF


def _ends(item: dict) -> tuple[str, str]:
    t = item["text"].strip()
    return t[:1], t[-1:]


def gap_between(a: dict, b: dict) -> float:
    """From the end of one item to the start of the next, whichever way the line runs."""
    return b["x"] - a["x"] - a["width"] if a["x"] <= b["x"] else a["x"] - b["x"] - b["width"]


# ---- gaps of a page ----------------------------------------------------------------------------------------------------


def gap_ratios(items: list[dict], short: int | None = None) -> np.ndarray:
    """Gaps of neighbours in parts of the font size, those from 0 to 3; none beside CJK. short: only where one of both has
    fewer characters."""
    out = []
    for a, b in zip(items, items[1:]):
        if short and min(len(a["text"].strip()), len(b["text"].strip())) >= short:
            continue
        if is_cjk(_ends(a)[1]) or is_cjk(_ends(b)[0]) or a["width"] <= 0 or a["font_size"] <= 0:
            continue
        r = gap_between(a, b) / a["font_size"]
        if 0 <= r <= 3:
            out.append(r)
    return np.sort(np.array(out))


def _wide(ratios: np.ndarray) -> bool:
    return len(ratios) >= 8 and ratios[0] >= 0.40


def letterspaced_threshold(items: list[dict]) -> float:
    """The join threshold of a page that is set letter by letter: 1.55 x the median gap, if all gaps are wide."""
    r = gap_ratios(items)
    return float(np.clip(r[len(r) // 2] * 1.55, 0.50, 2.0)) if _wide(r) else TIGHT


def two_class_threshold(items: list[dict]) -> float:
    """The join threshold that parts the gaps beside short fragments in two classes of greatest variance between them."""
    r = gap_ratios(items, short=5)
    if not _wide(r):
        return TIGHT
    n = np.arange(1, len(r))
    left = np.cumsum(r)[:-1]
    spread = n * (len(r) - n) * (left / n - (r.sum() - left) / (len(r) - n)) ** 2
    spread[np.diff(r) < 1e-6] = -NOWHERE
    if not np.isfinite(spread).any():
        return TIGHT
    best = int(spread.argmax())
    return float(np.clip((r[best] + r[best + 1]) / 2, 0.05, 2.0))


def is_letterspaced(text: str) -> bool:
    t = text.strip()
    return len(t) >= 3 and all((c == " ") == (i % 2 == 1) for i, c in enumerate(t))


def close_letterspaced(items: list[dict]) -> tuple[list[dict], float]:
    """Items without the spaces of letter-spaced ones, and the page's join threshold.

    If half of the items (four at least) are letter-spaced, all of these are closed; else only words of five letters or
    more that aren't all capitals. A page of single characters has a threshold of its own gaps."""
    told = [i for i in items if len(i["text"].strip().encode()) >= 3]
    spaced = sum(is_letterspaced(i["text"]) for i in told)
    closed = lambda i: i | {"text": i["text"].replace(" ", "")}
    if len(told) >= 4 and 2 * spaced >= len(told):
        return [closed(i) if is_letterspaced(i["text"]) else i for i in items], letterspaced_threshold(items)
    if len(items) >= 10 and 2 * sum(len(i["text"].strip()) == 1 for i in items) >= len(items):
        t = letterspaced_threshold(items)
        if t > 0.40:
            return items, t

    def word(text: str) -> bool:
        if not is_letterspaced(text):
            return False
        letters = [c for c in text if c.isalpha()]
        return len(letters) >= 5 and any(c.islower() or ord(c) > 127 for c in letters)

    return [closed(i) if word(i["text"]) else i for i in items], TIGHT


# ---- joining neighbours ------------------------------------------------------------------------------------------------

CLOSERS = ".,;!?)]}'"


def should_join(a: dict, b: dict, threshold: float = TIGHT) -> bool:
    """Whether an item goes on the word of the one before, rather than starting a new one."""
    if a["text"].endswith(" ") or b["text"].startswith(" "):
        return False
    last, first = a["text"].rstrip()[-1:], b["text"].lstrip()[:1]
    if first and first in CLOSERS:
        return True
    if last == ":" and first.isalnum():
        return False
    return _join_by_width(a, b, last, first, threshold) if a["width"] > 0 else _join_by_guess(a, b, last, first)


def _join_by_width(a: dict, b: dict, last: str, first: str, threshold: float) -> bool:
    size, gap = a["font_size"], gap_between(a, b)
    n, m = len(a["text"].strip()), len(b["text"].strip())
    if gap > 3 * size or gap < -size:
        return False
    if a["font"].startswith(("C2_", "C0_")) and 0 <= gap < 0.01 * size and not is_cjk(last) and not is_cjk(first):
        return len(a["text"].split()) >= 3  # such fonts show a word at a time, or a whole line that ends anywhere
    digit = lambda c: "0" <= c <= "9"
    if last and first:
        if (digit(last) or last in ",.") and (digit(first) or first in "%.") or last in "+-" and digit(first):
            return gap < 0.3 * size
    if threshold > 0.20:  # letter by letter: against the width of a letter
        return gap < a["width"] / n * 1.25 if n == 1 or (m == 1 and n) else gap < size * threshold
    if (n == 1) != (m == 1):
        return gap < 0.20 * size
    if n == 1 and m == 1:
        number = (digit(last) or last in ",.%+-") and (digit(first) or first in ",.%")
        return gap < size * (0.25 if number else threshold)
    return gap < size * (0.18 if n >= 2 and m >= 2 and last.islower() and first.islower() else 0.15)


def _join_by_guess(a: dict, b: dict, last: str, first: str) -> bool:
    char = a["font_size"] * 0.45
    gap = b["x"] - a["x"] - len(a["text"]) * char
    if gap > 6 * char:
        return False
    if is_cjk(last) or is_cjk(first):
        return gap < 0.8 * char
    if last.isalpha() and first.isalpha():
        if last.isupper() == first.isupper() and last.islower() == first.islower():
            return gap < 0.8 * char
        return not last.islower() and gap < 0.3 * char
    return gap < 0.5 * char


def needs_space(a: dict, b: dict, so_far: str, threshold: float = TIGHT) -> bool:
    """Whether a space goes between two items of a line whose text so far is given: none at hyphens, beside a raised or
    lowered small item, or where there is one."""
    if so_far.endswith(("-", " ")) or b["text"].strip() == "-" or b["text"].startswith(("-", " ")):
        return False
    small, large = sorted((a["font_size"], b["font_size"]))
    if large > 0 and small / large < 0.85 and abs(a["y"] - b["y"]) > 1:
        return False
    return not should_join(a, b, threshold)


def line_text(items: list[dict], threshold: float = TIGHT) -> str:
    out = ""
    for k, it in enumerate(items):
        out += (" " if k and needs_space(items[k - 1], it, out, threshold) else "") + it["text"]
    return out


def styled_text(items: list[dict], threshold: float = TIGHT, bold: bool = True, italic: bool = True) -> str:
    """The text of a line with ** and * around bold and italic items."""
    out, on = "", (False, False)
    for k, it in enumerate(items):
        text = it["text"].strip()
        if not text:
            continue
        space = bool(out) and (needs_space(items[k - 1], it, out, threshold) or it["text"].startswith(" ") and not out.endswith(" "))
        now = (bold and bool(it.get("bold")), italic and bool(it.get("italic")))
        out += ("*" if on[1] and not now[1] else "") + ("**" if on[0] and not now[0] else "") + (" " if space else "")
        out += ("**" if now[0] and not on[0] else "") + ("*" if now[1] and not on[1] else "") + text
        on = now
    return out + ("*" if on[1] else "") + ("**" if on[0] else "")


def _bands(items: list[dict], apart: float = 5.0) -> list[list[dict]]:
    """Items by height: each with the first band whose first item is less than that away."""
    out: list[list[dict]] = []
    for it in items:
        band = next((b for b in out if abs(b[0]["y"] - it["y"]) < apart), None)
        if band is None:
            out.append([it])
        else:
            band.append(it)
    return out


def is_rtl(texts: list[str]) -> bool:
    """Whether Hebrew and Arabic letters are more than the others."""
    if all(t.isascii() for t in texts):
        return False
    letters = [ord(c) for t in texts for c in t if c.isalpha()]
    there = sum(0x590 <= n <= 0x8FF or 0xFB1D <= n <= 0xFDFF or 0xFE70 <= n <= 0xFEFF for n in letters)
    return 2 * there > len(letters)


def by_direction(items: list[dict]) -> list[dict]:
    return sorted(items, key=lambda i: i["x"], reverse=is_rtl([i["text"] for i in items]))


def merge_items(items: list[dict]) -> list[dict]:
    """Neighbours of a line as one item: sizes within a fifth, a gap of at most three quarters of the size; a space where the
    gap is wider than usual before that character. Lines from top to bottom."""
    out: list[dict] = []
    for band in sorted(_bands(items), key=lambda b: -b[0]["y"]):
        own: dict | None = None
        for it in by_direction(band):
            gap = it["x"] - own["x"] - own["width"] if own else NOWHERE
            if own is None or not -0.5 * own["font_size"] <= gap <= 0.75 * own["font_size"] or abs(it["font_size"] - own["font_size"]) > 0.2 * own["font_size"]:
                own = dict(it)
                own["width"] = it["width"] if it["width"] > 0 else len(it["text"]) * it["font_size"] * 0.5
                out.append(own)
                continue
            first, last = it["text"].lstrip()[:1], own["text"].rstrip()[-1:]
            capitals = "A" <= first <= "Z" and "A" <= last <= "Z"
            wide = 0.25 if first and first in ".,;)]}" else 0.18 if capitals else 0.13
            own["text"] += (" " if gap > wide * own["font_size"] else "") + it["text"]
            own["width"] = right(it) - own["x"]
    return out


def merge_subscripts(items: list[dict]) -> list[dict]:
    """Small numbers right after a letter as part of that item, as in H2O."""
    out: list[dict] = []
    for band in _bands(items):
        most = max(i["font_size"] for i in band)
        line: list[dict] = []
        for it in sorted(band, key=lambda i: i["x"]):
            small = most >= 1 and 0 < it["font_size"] < 0.75 * most and len(it["text"]) <= 4 and it["text"].isascii() and it["text"].isdigit()
            above = line[-1] if line else None
            if small and above and above["font_size"] >= 0.75 * most and above["text"][-1:].isalpha():
                if -0.3 * above["font_size"] < it["x"] - above["x"] - above["width"] < 0.2 * above["font_size"]:
                    line[-1] = above | {"text": above["text"] + it["text"], "width": it["x"] + it["width"] - above["x"]}
                    continue
            line.append(it)
        out += line
    return out


# ---- columns -----------------------------------------------------------------------------------------------------------

STEP = 2.0
Span = tuple[float, float]


def occupancy(items: list[dict], lo: float, hi: float, step: float = STEP) -> np.ndarray:
    """How many items stand over each step of a page's width; items wider than three fifths of it don't count."""
    n = max(1, int(np.ceil((hi - lo) / step)))
    edge = np.zeros(n + 1, np.int64)
    for i in items:
        if effective_width(i) <= 0.6 * (hi - lo):
            a, b = min(n, int((i["x"] - lo) // step)), min(n, int(np.ceil((right(i) - lo) / step)))
            edge[a] += 1
            edge[max(a, b)] -= 1
    return np.cumsum(edge)[:n]


def absolute_valleys(bins: np.ndarray, width: float, step: float = STEP) -> list[tuple[int, int]]:
    """Runs of steps with at most 15 % of the most items, 8 points wide or more, and not within 5 % of the page's edges."""
    low = np.concatenate([[False], bins <= int(bins.max() * 0.15), [False]])
    edges = np.flatnonzero(np.diff(low.astype(np.int8))).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if (b - a) * step >= 8 and 0.05 * width < (a + b) / 2 * step < 0.95 * width]


def relative_valleys(bins: np.ndarray, width: float, step: float = STEP, window: int = 25) -> list[tuple[int, int]]:
    """The deepest dip of the smoothed counts: below 60 % of the peaks (20 or more, of like height) within 50 points."""
    n = len(bins)
    if n < 10:
        return []
    sums = np.concatenate([[0], np.cumsum(bins)])
    lo, hi = np.maximum(np.arange(n) - 2, 0), np.minimum(np.arange(n) + 3, n)
    smooth = (sums[hi] - sums[lo]) / (hi - lo)
    found = []
    for i in range(window, max(window, n - window)):
        v, a, b = smooth[i], smooth[i - window : i].max(), smooth[i + 1 : i + 1 + window].max(initial=0)
        if v < 1 or smooth[max(0, i - 3) : i + 4].min() < v - 0.5 or min(a, b) < 20 or min(a, b) < 0.4 * max(a, b):
            continue
        if v < 0.6 * min(a, b) and 0.05 * width < i * step < 0.95 * width:
            found.append((v / min(a, b), i))
    if not found:
        return []
    i = min(found)[1]
    return [(max(0, i - 2), min(n, i + 3))]


def _cut(valleys: list[tuple[int, int]], items: list[dict], lo: float, hi: float, by_centre: bool, step: float = STEP) -> list[Span]:
    """The columns between valleys that have enough items on both sides over a shared height; four at most."""
    place = centre if by_centre else (lambda i: i["x"])
    cuts: list[float] = []
    for a, b in valleys:
        x = lo + (a + b) / 2 * step
        sides = [[i for i in items if (place(i) <= x) == left] for left in (True, False)]
        if min(map(len, sides)) < 3 or max(map(len, sides)) < 10:
            continue
        (l0, l1), (r0, r1) = ((min(i["y"] for i in s), max(i["y"] for i in s)) for s in sides)
        if min(l1, r1) - max(l0, r0) < 0.3 * max(1.0, max(l1, r1) - min(l0, r0)):
            continue
        if all(i["text"].strip()[:2].rstrip(".)") .isdigit() or i["text"].strip()[:1] in "•-–*" for i in sides[0]):
            continue  # the markers of a list
        cuts.append(x)
    edges = [lo, *cuts[:3], hi]
    return list(zip(edges, edges[1:]))


def has_prose(columns: list[Span], items: list[dict]) -> bool:
    """Whether every column reads as running text: 120 points wide, eight lines of few items, two fifths of them filled."""
    for a, b in columns:
        own = sorted((i for i in items if a <= centre(i) <= b), key=lambda i: -i["y"])
        lines: list[list[dict]] = []
        for it in own:
            if lines and abs(lines[-1][0]["y"] - it["y"]) < 3:
                lines[-1].append(it)
            else:
                lines.append([it])
        full = sum(min(b, max(map(right, x))) - max(a, min(i["x"] for i in x)) >= 0.45 * (b - a) for x in lines)
        if b - a < 120 or len(lines) < 8 or full < 0.4 * len(lines) or len(own) > 3.5 * len(lines):
            return False
    return True


def widest_gap(items: list[dict], lo: float, hi: float) -> list[Span]:
    """Two columns at the widest gap that no item crosses: 15 points or more, not within a tenth of the edges, with items
    enough on both sides over a shared height. Empty if there is none."""
    if hi - lo < 200 or len(items) < 2:
        return []
    order = sorted(items, key=lambda i: i["x"])
    ends = np.maximum.accumulate([right(i) for i in order])[:-1]
    starts = np.array([i["x"] for i in order])[1:]
    k = int((starts - ends).argmax())
    x = (ends[k] + starts[k]) / 2
    if starts[k] - ends[k] < 15 or min(x - lo, hi - x) < 0.1 * (hi - lo):
        return []
    sides = [[i["y"] for i in items if (centre(i) <= x) == left] for left in (True, False)]
    if min(map(len, sides)) < 3 or max(map(len, sides)) < 10:
        return []
    shared = min(map(max, sides)) - max(map(min, sides))
    return [(lo, x), (x, hi)] if shared >= 0.2 * max(1.0, max(map(max, sides)) - min(map(min, sides))) else []


def columns(items: list[dict], has_table: bool = False) -> list[Span]:
    """The columns of a page, one at least: by clear valleys, else (100 items or more, no table) by a dip between columns of
    prose, else by the widest gap."""
    if not items:
        return []
    lo, hi = min(i["x"] for i in items), max(map(right, items))
    if len(items) < 20 or hi - lo < 200:
        return [(lo, hi)]
    bins = occupancy(items, lo, hi)
    valleys = absolute_valleys(bins, hi - lo)
    if valleys:
        for by_centre in (True, False):
            found = _cut(valleys, items, lo, hi, by_centre)
            if len(found) > 1:
                return found
        if has_table:
            return [(lo, hi)]
    elif len(items) >= 100 and not has_table:
        found = _cut(relative_valleys(bins, hi - lo), items, lo, hi, True)
        if len(found) > 1 and has_prose(found, items):
            return found
    return widest_gap(items, lo, hi) or [(lo, hi)]


def spanning(items: list[dict], cols: list[Span]) -> list[bool]:
    """Which items belong to lines over several columns: titles and the like, wider than 1.3 columns with no gap at a gutter."""
    out = [False] * len(items)
    if len(items) < 3 or len(cols) < 2:
        return out
    wide = 1.3 * max(b - a for a, b in cols)
    gutters = [b for _, b in cols[:-1]]
    order = sorted(range(len(items)), key=lambda i: -items[i]["y"])
    lines: list[list[int]] = []
    for i in order:
        if lines and abs(items[lines[-1][0]]["y"] - items[i]["y"]) < 5:
            lines[-1].append(i)
        else:
            lines.append([i])
    for line in lines:
        line.sort(key=lambda i: items[i]["x"])
        if len(line) < 2 or right(items[line[-1]]) - items[line[0]]["x"] <= wide:
            continue
        gaps = [(right(items[a]), items[b]["x"]) for a, b in zip(line, line[1:])]
        if not any(b - a >= 5 and a - 15 < g < b + 15 for a, b in gaps for g in gutters):
            for i in line:
                out[i] = True
    return out


def crosses(item: dict, cols: list[Span]) -> bool:
    """Whether an item stands over two columns or more, by a tenth of their width or 20 points."""
    over = [min(right(item), b) - max(item["x"], a) for a, b in cols]
    return sum(o > 0 and (o > 0.1 * (b - a) or o > 20) for o, (a, b) in zip(over, cols)) >= 2


def best_column(item: dict, cols: list[Span]) -> int:
    """The column that an item overlaps most; the first of equal ones."""
    over = [max(0.0, min(right(item), b) - max(item["x"], a)) for a, b in cols]
    return over.index(max(over))


def line_up(items: list[dict], threshold: float = TIGHT) -> list[dict]:
    """Items of one column as lines {items, y, text, threshold}, from top to bottom.

    Items are taken in the order of the stream unless over two fifths of its steps by 50 points (three or more) go up."""
    steps = [b["y"] - a["y"] for a, b in zip(items, items[1:])]
    up, down = sum(s > 50 for s in steps), sum(s < -50 for s in steps)
    if len(items) >= 5 and up + down >= 3 and up > 0.4 * (up + down):
        items = sorted(items, key=lambda i: (-i["y"], i["x"]))
    rows: list[list[dict]] = []
    for it in items:
        row = rows[-1] if rows else None
        lower = abs(row[0]["y"] - it["y"]) if row else NOWHERE
        # a line of its own: starts where the line before starts, or to the left of where that ends, and lower
        stacked = row is not None and lower > 0.5 and (abs(it["x"] - row[0]["x"]) < 5 or it["x"] < row[-1]["x"] - 10)
        if row is None or lower >= 3 or stacked:
            rows.append([it])
        else:
            row.append(it)
    rows.sort(key=lambda r: -r[0]["y"])
    return [_line(by_direction(r), r[0]["y"], threshold) for r in rows]


def _line(items: list[dict], y: float, threshold: float) -> dict:
    return {"items": items, "y": y, "threshold": threshold, "text": line_text(items, threshold)}


def is_newspaper(per_column: list[list[dict]], cols: list[Span]) -> bool:
    """Whether columns are read one after the other: 15 lines or more in each, of like number or at the same heights; or a
    narrow column of sparse notes beside a wide one."""
    if len(per_column) < 2:
        return False
    counts = [len(c) for c in per_column]
    least, most = min(counts), max(counts)
    if least < 5:
        return False
    if least < 15:
        if len(cols) != 2:
            return False
        widths = [b - a for a, b in cols]
        narrow = widths.index(min(widths))
        step = lambda c: (max(x["y"] for x in c) - min(x["y"] for x in c)) / (len(c) - 1)
        body = step(per_column[1 - narrow])
        notes = min(widths) < 0.5 * max(widths) and least < 0.35 * most and most >= 20 and min(widths) >= 160
        return notes and counts[narrow] == least and body > 0 and step(per_column[narrow]) >= 2.5 * body
    if least > 0.7 * most:
        return True
    k = counts.index(least)
    others = np.sort([x["y"] for j, c in enumerate(per_column) if j != k for x in c])
    beside = 0
    for x in per_column[k]:
        at = np.searchsorted(others, x["y"])
        beside += min((abs(others[j] - x["y"]) for j in (at - 1, at) if 0 <= j < len(others)), default=NOWHERE) < 5
    return beside > 0.5 * least


def part_stragglers(lines: list[dict]) -> tuple[list[dict], list[dict]]:
    """The longest run of lines without a gap of three usual ones (30 points at least), and the other lines."""
    gaps = [a["y"] - b["y"] for a, b in zip(lines, lines[1:])]
    if len(lines) < 3:
        return lines, []
    wide = max(30.0, 3 * sorted(gaps)[len(gaps) // 2])
    runs: list[list[dict]] = [[lines[0]]]
    for gap, x in zip(gaps, lines[1:]):
        if gap > wide:
            runs.append([])
        runs[-1].append(x)
    core = max(range(len(runs)), key=lambda i: (len(runs[i]), i))
    return runs[core], [x for i, r in enumerate(runs) if i != core for x in r]


def is_page_number(item: dict) -> bool:
    """One to four digits at the top or the bottom of a page."""
    t = item["text"].strip()
    return 0 < len(t) <= 4 and t.isascii() and t.isdigit() and (item["y"] > 720 or item["y"] < 100)


def page_reading(items: list[dict], threshold: float = TIGHT, has_table: bool = False) -> list[dict]:
    """The lines of a page in reading order."""
    items = [i for i in items if not is_page_number(i)]
    cols = columns(items, has_table)
    if len(cols) < 2:
        return line_up(items, threshold)
    mask = spanning(items, cols)
    wide = [m or crosses(i, cols) for i, m in zip(items, mask)]
    buckets: list[list[dict]] = [[] for _ in cols]
    for it, w in zip(items, wide):
        if not w:
            buckets[best_column(it, cols)].append(it)
    across = line_up([i for i, w in zip(items, wide) if w], threshold)
    per_column = [line_up(b, threshold) for b in buckets]
    if is_newspaper(per_column, cols):
        parted = [part_stragglers(c) for c in per_column]
        top = min((max(x["y"] for x in core) for core, _ in parted if core), default=NOWHERE) + 5
        above = [x for x in across if x["y"] > top] + [x for _, rest in parted for x in rest if x["y"] > top]
        down = lambda xs: sorted(xs, key=lambda x: -x["y"])
        return [*down(above), *(x for core, _ in parted for x in core), *(x for _, rest in parted for x in rest if x["y"] <= top), *down(x for x in across if x["y"] <= top)]
    # rows of several columns: what stands at one height is one line
    out: list[dict] = []
    for x in sorted([*across, *(x for c in per_column for x in c)], key=lambda x: (-x["y"], x["items"][0]["x"])):
        if out and abs(out[-1]["y"] - x["y"]) < 3:
            out[-1] = _line(by_direction(out[-1]["items"] + x["items"]), out[-1]["y"], threshold)
        else:
            out.append(x)
    return out


# ---- bands of a page ---------------------------------------------------------------------------------------------------


def is_numeric(item: dict) -> bool:
    t = item["text"].strip()
    return bool(t) and sum(c in "0123456789,.-+%€$£¥()" for c in t) >= 0.6 * len(t)


def side_by_side(items: list[dict]) -> list[Span]:
    """Left and right half of a page with two regions beside each other: a gap between item starts of 30 points or more in
    the middle, a fifth of the items on both sides, hardly any across. Empty for one region, for several such gaps far apart
    (a wide table), and for labels with numbers beside them."""
    n = len(items)
    if n < 40:
        return []
    xs = sorted(i["x"] for i in items)
    lo, hi = xs[0], xs[-1]
    cuts = [(a + b) / 2 for k, (a, b) in enumerate(zip(xs, xs[1:]), 1) if b - a >= 30 and 20 <= k <= n - 20 and 0.2 <= ((a + b) / 2 - lo) / (hi - lo) <= 0.8]
    middles = np.array([i["x"] + i["width"] / 2 for i in items])
    cuts = [x for x in cuts if min((middles < x).sum(), (middles >= x).sum()) >= n // 5]
    if not cuts or any(b - a >= 50 for a, b in zip(cuts, cuts[1:])):
        return []
    over = lambda x: sum(i["x"] < x < i["x"] + i["width"] for i in items)
    x = min(cuts, key=over)
    if over(x) > max(n // 20, 2):
        return []
    left, rest = [i for i, m in zip(items, middles) if m < x], [i for i, m in zip(items, middles) if m >= x]
    share = lambda s: sum(map(is_numeric, s)) / len(s)
    if left and rest and share(left) < 0.3 and share(rest) >= 0.7:
        heights = np.sort([i["y"] for i in left])
        beside = sum(np.searchsorted(heights, i["y"] - 5, "right") < np.searchsorted(heights, i["y"] + 5) for i in rest)
        if beside >= 0.5 * len(rest):
            return []
    return [(lo, x), (x, hi)]


def in_band(rects: list[tuple], lo: float, hi: float) -> list[tuple]:
    """Rectangles (x, y, width, height) that overlap a band; of those as wide as 70 % of it, what is inside by 70 %."""
    out = []
    for r in rects:
        a, b = sorted((r[0], r[0] + r[2]))
        over = min(b, hi) - max(a, lo)
        if over > 0 and (b - a < 0.7 * (hi - lo) or over >= 0.7 * (b - a)):
            out.append(r)
    return out


def segments_in_band(segments: list[tuple], lo: float, hi: float) -> list[tuple]:
    """Segments (x1, y1, x2, y2) that overlap a band."""
    return [s for s in segments if max(s[0], s[2]) > lo and min(s[0], s[2]) < hi]


# ---- headings ----------------------------------------------------------------------------------------------------------

HEADINGS = {"H": 1, "H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6}
#: Roles of a tagged document that say nothing of a line.
WRAPPERS = frozenset("Document Part Art Sect Div NonStruct Span Private".split())


def line_size(line: dict) -> float:
    return line["items"][0]["font_size"] if line["items"] else 0.0


def size_level(size: float, base: float, tiers: list[float]) -> int | None:
    """The heading tier within half a point; without tiers by the ratio to the body size."""
    for i, t in enumerate(tiers):
        if abs(t - size) <= 0.5:
            return i + 1
    ratio = size / base if base else 0
    return None if tiers or ratio < 1.2 else 1 if ratio >= 2 else 2 if ratio >= 1.5 else 3 if ratio >= 1.25 else 4


def line_role(line: dict, roles: dict[int, str]) -> str | None:
    """The first telling role among a line's items, by their marked-content ids."""
    return next((r for i in line["items"] if (r := roles.get(i.get("mcid"))) and r not in WRAPPERS), None)


def heading_level(line: dict, base: float, tiers: list[float], roles: dict[int, str] | None = None) -> int | None:
    """The level by a heading tag of one of the items, else by the size of the first."""
    tagged = next((HEADINGS[r] for i in line["items"] if (r := (roles or {}).get(i.get("mcid"))) in HEADINGS), None)
    return tagged or size_level(line_size(line) or base, base, tiers)


def bold_level(tiers: list[float]) -> int:
    """The level of a bold line of body size: below the tiers, from 2 to 6."""
    return min(6, max(2, len(tiers) + 1))


def rarity(size: float, counts: dict[int, int]) -> float:
    """How seldom a font size (in tenths) is among lines: 0 the only one, 1 never."""
    total = sum(counts.values())
    return 1 - counts.get(int(size * 10), 0) / total if total else 0.0


def overused_levels(lines: list[dict], roles: dict[int, dict[int, str]]) -> set[int]:
    """Heading levels that over 15 % of the tagged lines (20 or more) have: these are body text with a wrong tag."""
    found = [r for x in lines if (r := line_role(x, roles.get(x.get("page", 1), {})))]
    levels = [HEADINGS[r] for r in found if r in HEADINGS]
    return {k for k in set(levels) if len(found) >= 20 and levels.count(k) > 0.15 * len(found)}


def merge_headings(lines: list[dict], base: float, tiers: list[float], roles: dict[int, str] | None = None) -> list[dict]:
    """Heading lines of one level that follow within two font sizes as one line, up to 20 words."""
    out: list[dict] = []
    for x in lines:
        level = heading_level(x, base, tiers, roles)
        above = out[-1] if out else None
        if level and above and 0 < above["y"] - x["y"] < 2 * line_size(x) and heading_level(above, base, tiers, roles) == level:
            if len(above["text"].split()) + len(x["text"].split()) <= 20:
                first = x["items"][0] | {"text": " " + x["items"][0]["text"].lstrip()}
                joined = _line([*above["items"], first, *x["items"][1:]], above["y"], above["threshold"])
                out[-1] = above | joined
                continue
        out.append(x)
    return out


def merge_drop_caps(lines: list[dict], base: float) -> list[dict]:
    """A large capital (2.5 x the body size) goes before the first line of the page that starts a paragraph in lower case."""
    out: list[dict] = []
    lower = lambda x: x["text"].strip()[:1].islower()
    for x in lines:
        t = x["text"].strip()
        if not (0 < len(t.encode()) <= 2 and line_size(x) >= 2.5 * base and t[0].isupper()):
            out.append(x)
            continue
        k = next((k for k, y in enumerate(out) if lower(y) and (k == 0 or not lower(out[k - 1]))), None)
        if k is not None:
            first = out[k]["items"][0] | {"text": t[0] + out[k]["items"][0]["text"].strip()}
            out[k] = out[k] | _line([first, *out[k]["items"][1:]], out[k]["y"], out[k]["threshold"])
    return out


def is_centred(line: dict, left: float, width: float) -> bool:
    """Whether a line of up to 120 characters is set in the middle of a text area: not wide, clear of the left margin, its
    middle within 8 % of the area's."""
    if not line["items"] or width < 50:
        return False
    a, last = line["items"][0]["x"], line["items"][-1]
    b = last["x"] + last["width"]
    return b - a <= 0.8 * width and a >= left + 0.1 * width and abs((a + b) / 2 - left - width / 2) <= 0.08 * width and sum(len(i["text"].encode()) for i in line["items"]) <= 120


# ---- as columns and rows -----------------------------------------------------------------------------------------------


def rarity_column(size: Column, count: Column, total: Column) -> Column:
    """`rarity` over counts of font sizes."""
    return F.when(total > 0, 1 - F.coalesce(count, F.lit(0)) / total).otherwise(F.lit(0.0))


def bold_level_column(tiers: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(2), F.size(tiers) + 1))


def effective_width_column(text: Column, width: Column, size: Column) -> Column:
    return F.when(width > 0, width).otherwise(F.length(text) * size * 0.5)


LINES = "page int, line_no int, text string, x double, y double, x2 double, font_size double, items int"


def reading_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, x, y, x2, font_size, items) in reading order, from items (doc_id, page, idx, text, x, y,
    width, font, font_size): a page at a time, its letter spacing closed, fragments merged, columns read one by one."""
    id_type = items.schema["doc_id"].dataType.simpleString()

    def run(key, t):
        own = t.sort_by("idx").select(["text", "x", "y", "width", "font", "font_size"]).to_pylist()
        own, threshold = close_letterspaced([i | {"font": i["font"] or ""} for i in own if i["text"]])
        lines = page_reading(merge_subscripts(merge_items(own)), threshold)
        n = len(lines)
        made = {
            "text": pa.array([x["text"].strip() for x in lines], pa.string()),
            "x": pa.array([x["items"][0]["x"] for x in lines], pa.float64()),
            "y": pa.array([x["y"] for x in lines], pa.float64()),
            "x2": pa.array([right(x["items"][-1]) for x in lines], pa.float64()),
            "font_size": pa.array([max(i["font_size"] for i in x["items"]) for x in lines], pa.float64()),
            "items": pa.array([len(x["items"]) for x in lines], pa.int32()),
        }
        cols = [pa.array([key[0].as_py()] * n, t.schema.field("doc_id").type), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), *made.values()]
        return pa.table(cols, ["doc_id", "page", "line_no", *made])

    return items.groupBy("doc_id", "page").applyInArrow(run, f"doc_id {id_type}, {LINES}")


def pages_of(lines: list[dict]) -> dict[int, list[dict]]:
    return {p: list(g) for p, g in groupby(lines, key=lambda x: x.get("page", 1))}

"""Markdown of a document of pages: the tables of each page, what is left in reading order, both as one text.

A page is a dict of items, rects, segments, height and, for tagged documents, roles (by marked-content id). One document at a time:
headings, paragraph gaps and running lines are those of the whole document."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from ..functions.text import BULLETS, CAPTION_PREFIXES, HYPHEN_LETTERS, MONOSPACE_FONTS
from . import page_tables as T, reading as R

FAR = float("inf")


@dataclass(frozen=True)
class Options:
    """base: the body size, where it is known; repeated: whether running headers and footers go; numbers: page markers."""

    base: float | None = None
    headers: bool = True
    lists: bool = True
    code: bool = True
    bold: bool = True
    italic: bool = True
    centred: bool = True
    quotes: bool = True
    repeated: bool = True
    numbers: bool = False
    page_numbers: bool = True
    hyphens: bool = True
    urls: bool = True


# ---- lines -------------------------------------------------------------------------------------------------------------


def is_caption(t: str) -> bool:
    t = t.strip()
    return t.startswith(CAPTION_PREFIXES) or re.match(r"(?i)(figure|table) \s*[0-9(#]|source:", t) is not None


def has_bullet(t: str) -> bool:
    return re.match(rf"\s*[{BULLETS}*-] ", t) is not None


def is_item(t: str) -> bool:
    head = t.lstrip()[:5]
    numbered = re.search("[0-9]", head) is not None and re.match("[0-9]*[.)]", head) is not None
    return has_bullet(t) or numbered or re.match(r"\s*([A-Za-z][.)]|\(.\))", t) is not None


def list_item(t: str) -> str:
    return re.sub(rf"^(\*{{0,2}})[{BULLETS}]\s*", r"- \1", t.lstrip())


def has_leaders(t: str) -> bool:
    return "...." in t or len(re.findall(r"\.{3,}", t)) >= 2


@lru_cache(maxsize=4096)
def is_code_font(font: str) -> bool:
    return any(f in font.lower() for f in MONOSPACE_FONTS)


def size_counts(sizes: list[float]) -> Counter:
    """Of font sizes of 9 points or more, in tenths."""
    return Counter(int(s * 10) for s in sizes if s >= 9)


def body_size(counts: Counter) -> float:
    """The commonest; the smaller of equally common ones; else 12."""
    return min(counts, key=lambda s: (-counts[s], s)) / 10 if counts else 12.0


def heading_tiers(sizes: list[float], base: float) -> list[float]:
    """Up to four sizes of 1.2 x the body size or more, half a point apart, the largest first."""
    out: list[float] = []
    for s in sorted({int(s * 10) / 10 for s in sizes if s >= 1.2 * base}, reverse=True):
        if not out or out[-1] - s > 0.5:
            out.append(s)
    return out[:4]


def paragraph_gap(lines: list[dict], base: float) -> float:
    """The gap over which a paragraph ends: the upper median of the gaps under 10 x base, x 1.3, at least 1.5 x base; with fewer
    than five gaps 1.8 x base."""
    gaps = sorted(g for a, b in zip(lines, lines[1:]) if a["page"] == b["page"] and 0 < (g := a["y"] - b["y"]) < 10 * base)
    return max(gaps[len(gaps) // 2] * 1.3, base * 1.5) if len(gaps) >= 5 else base * 1.8


#: Words with which a line that goes on may end.
GOES_ON = "the a an and or of in to for with by on at from as is are was were be that this their its our your has have had not".split()


def isolated(lines: list[dict], base: float, gap: float) -> set[int]:
    """The lines that stand alone between paragraph gaps as headings of body size do; none of a page on which over a quarter do."""

    def alone(k: int) -> bool:
        x = lines[k]
        words = x["text"].split()
        t = " ".join(words)
        if not 1 <= len(words) <= 6 or len(t.encode()) <= 3 or R.line_size(x) < 0.95 * base or is_item(t) or is_caption(t):
            return False
        if t[-1] in "-,;" or words[-1].lower() in GOES_ON:
            return False
        beside = [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(lines) and lines[j]["page"] == x["page"]]
        return all(abs(x["y"] - y["y"]) > gap for y in beside)

    found = {k for k in range(len(lines)) if alone(k)}
    total, own = Counter(x["page"] for x in lines), Counter(lines[k]["page"] for k in found)
    return {k for k in found if own[lines[k]["page"]] <= 0.25 * total[lines[k]["page"]]}


def margins(lines: list[dict]) -> dict[int, tuple[float, float, bool]]:
    """For each page with three lines of three items or more: left margin, width, and whether that margin is where most lines
    start (half of them) on a page without several columns."""
    out = {}
    by: dict[int, list[dict]] = {}
    for x in lines:
        if len(x["items"]) >= 3:
            by.setdefault(x["page"], []).append(x)
    for page, own in by.items():
        n = len(own)
        if n < 3:
            continue
        steps = Counter(round(x["items"][0]["x"] / 5) for x in own)
        best = min(steps, key=lambda s: (-steps[s], s))
        ends = sorted(x["items"][-1]["x"] + x["items"][-1]["width"] for x in own)
        strong = sorted(s for s, c in steps.items() if c * 5 >= n)
        several = any(b - a >= 24 for a, b in zip(strong, strong[1:]))
        there = sum(c for s, c in steps.items() if abs(s - best) <= 2)
        out[page] = (best * 5.0, max(ends[n * 9 // 10] - best * 5.0, 1.0), there > 0.5 * n and not several)
    return out


def _compared(t: str) -> str:
    t = re.sub(r"^[0-9]+", "", " ".join(t.split())).lstrip()
    return re.sub(r"[0-9]+$", "", t).rstrip()


def without_running(lines: list[dict], pages: int, edge: int = 5) -> list[dict]:
    """Lines without running headers and footers: among the first or last five heights of a page, ten bytes or more, no list or
    heading, on three pages and 30 % of them at about one height. The first page keeps it; what stands at its height goes
    with it."""
    if pages < 3 or not lines:
        return lines
    heights: dict[int, list[float]] = {}
    for x in lines:
        heights.setdefault(x["page"], []).append(x["y"])
    rank = {}
    for p, ys in heights.items():
        order = sorted(set(ys))
        rank[p] = {y: min(k, len(order) - 1 - k) for k, y in enumerate(order)}
    span = max(1.0, sum(max(ys) - min(ys) for ys in heights.values()) / len(heights))
    at_edge = [rank[x["page"]][x["y"]] < edge for x in lines]
    bands: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(lines):
        if at_edge[k]:
            bands.setdefault((x["page"], round(x["y"] * 10)), []).append(k)
    seen: dict[str, list[tuple[int, float]]] = {}
    names: dict[tuple[int, int], set[str]] = {}
    for band, ks in bands.items():
        said = {_compared(lines[k]["text"]) for k in ks} | {_compared(" ".join(lines[k]["text"] for k in ks))}
        names[band] = {t for t in said if len(t.encode()) >= 10 and len(set(t)) > 1 and not re.match(r"\s*(#|[-*•] |[0-9].*[.)] )", t)}
        for t in names[band]:
            seen.setdefault(t, []).append((band[0], lines[ks[0]]["y"]))
    running = {}
    for t, at in seen.items():
        ys = [y for _, y in at]
        mean = sum(ys) / len(ys)
        steady = (sum((y - mean) ** 2 for y in ys) / len(ys)) ** 0.5 < 0.05 * span
        if len({p for p, _ in at}) >= max(3, pages * 30 // 100) and steady:
            running[t] = min(p for p, _ in at)
    gone = {k for band, ks in bands.items() if any(t in running and running[t] < band[0] for t in names[band]) for k in ks}
    return [x for k, x in enumerate(lines) if k not in gone]


# ---- tables of a page --------------------------------------------------------------------------------------------------


def page_layout(page: dict, base: float, tables: list, number: int, above: dict | None = None) -> dict:
    """What a page's items make: tables (height, markdown, kind), the indices of items that they take, the bands that lines
    must not cross, and the last table that rectangles draw. Detectors run in turn on what is left: tags, rectangles, rules,
    hints, text, columns; then thin rectangles as rules, and the whole page, where it was parted in vain. above: the last
    table that rectangles draw on the page before."""
    items = page["items"]
    found, taken, grid = [], set(), None
    parted = R.side_by_side(items)
    split = [] if parted else T.hint_bands(items, page["rects"])
    spans = parted or split

    def add(t: dict, of: list[int]) -> None:
        found.append((t["rows"][0] if t["rows"] else 0.0, T.markdown(t), t["kind"], len(t["columns"])))
        taken.update(of[k] for k in t["items"])

    for lo, hi in spans or [(-FAR, FAR)]:
        of = [k for k, i in enumerate(items) if not spans or lo - 2 <= i["x"] < hi + 2]
        own = [items[k] for k in of]
        rects = R.in_band(page["rects"], lo, hi) if spans else page["rects"]
        rules = R.segments_in_band(page["segments"], lo, hi) if spans else page["segments"]
        before = len(taken)
        claimed: set[int] = set()

        def claim(t: dict, of=of, claimed=claimed) -> None:
            add(t, of)
            claimed.update(t["items"])

        for t in T.tagged_tables(own, tables, number):
            if len(t["items"]) >= 0.5 * max(1, len(own)):
                claim(t)
        drawn, hints = T.rect_tables(own, rects)
        if not drawn and above:
            drawn = T.continued_grid(own, rects, above)
        for t in drawn:
            if not claimed.intersection(t["items"]):
                claim(t)
                grid = t
        if not claimed and (t := T.rule_table(own, rules)):
            claim(t)
        if not claimed:
            for h in hints:
                inside = T.inside_hint(own, h)
                t = T.guided_table([own[k] for k in inside], h["rects"])
                if t:
                    add(t, [of[k] for k in inside])
                    claimed.update(inside)
        areas = []
        if not claimed and hints:
            for h in hints:
                areas.append(T.inside_hint(own, h, whole_width=True))
                claimed.update(areas[-1])
        areas.append([k for k in range(len(own)) if k not in claimed])
        for area in areas:
            for t in T.text_tables([own[k] for k in area], base):
                add(t, [of[k] for k in area])
        if len(taken) == before and len(rects) < 6 and len(rules) < 4 and (t := T.column_table(own)):
            add(t, of)
    every = list(range(len(items)))
    if not found:
        thin = [(min(x, x + w), min(y, y + h), abs(w), abs(h)) for x, y, w, h in page["rects"]]
        rules = [(x, y + h / 2, x + w, y + h / 2) for x, y, w, h in thin if h < 2 and w >= 10] + [(x + w / 2, y, x + w / 2, y + h) for x, y, w, h in thin if w < 2 and h >= 10]
        if len(rules) >= 10 and (t := T.rule_table(items, rules)):
            add(t, every)
    if spans and not found:
        for t in T.text_tables(items, base, len(R.columns(items)) >= 2):
            add(t, every)
    return {"tables": found, "taken": taken, "bands": split, "grid": grid}


def merge_continued(tables: dict[int, list[tuple]], whole: set[int]) -> dict[int, list[tuple]]:
    """Tables that go on over pages which hold nothing else, one each, of equal columns, as one: without the later headers."""
    out: dict[int, list[tuple]] = {}
    last: int | None = None  # the page before, if a table may go on from it
    head: int | None = None
    for p in sorted(tables):
        own = tables[p]
        alone = p in whole and len(own) == 1 and own[0][1].count("\n") >= 2 and "---" in own[0][1].splitlines()[1]
        width = own[0][1].splitlines()[1].count("---") if alone else 0
        if alone and last == p - 1 and head is not None and width == out[head][0][1].splitlines()[1].count("---"):
            y, text, *more = out[head][0]
            out[head][0] = (y, text + "".join(x + "\n" for x in own[0][1].splitlines()[2:]), *more)
        else:
            out[p] = list(own)
            head = p if alone else None
        last = p if alone else None
    return out


def page_lines(page: dict, layout: dict, number: int) -> list[dict]:
    """The lines of what tables leave, in reading order; of a page in bands from top to bottom of both."""
    items = [i for k, i in enumerate(page["items"]) if k not in layout["taken"]]
    threshold, has_table = page.get("threshold", R.TIGHT), bool(layout["tables"])
    if layout["bands"]:
        parts = [R.page_reading([i for i in items if lo - 2 <= i["x"] < hi + 2], threshold, has_table) for lo, hi in layout["bands"]]
        lines = sorted((x for p in parts for x in p), key=lambda x: -x["y"])
    else:
        lines = R.page_reading(items, threshold, has_table)
    return [x | {"page": number} for x in lines]


# ---- the text ----------------------------------------------------------------------------------------------------------


class _Text:
    """The markdown so far, and whether a paragraph, list, quote or code block is open."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.paragraph = self.quote = self.code = False

    def close(self, code: bool = True) -> None:
        if code and self.code:
            self.out.append("```\n")
            self.code = False
        if self.quote:
            self.out.append("\n")
            self.quote = False
        if self.paragraph:
            self.out.append("\n\n")
            self.paragraph = False

    def block(self, text: str) -> None:
        self.close()
        self.out.append(text)


def to_markdown(lines: list[dict], options: Options, tables: dict[int, list[tuple]] | None = None, bands: set[int] = frozenset(), roles: dict[int, dict[int, str]] | None = None) -> str:
    """Lines of a document (with page) and its pages' tables as markdown: headings by tag, size, rarity and place, lists with
    their wrapped lines, captions, quotes and centred lines, code, paragraphs."""
    tables = dict(tables or {})
    if not lines and not tables:
        return ""
    roles = roles or {}
    counts = size_counts([R.line_size(x) for x in lines if x["items"]])
    base = options.base or body_size(counts)
    of_page = lambda made, own: [x | {"page": own[0]["page"]} for x in made]
    by_page = R.pages_of(lines)
    lines = [x for own in by_page.values() for x in of_page(R.merge_drop_caps(own, base), own)]
    tiers = heading_tiers([R.line_size(x) for x in lines], base)
    lines = [x for p, own in R.pages_of(lines).items() for x in of_page(R.merge_headings(own, base, tiers, roles.get(p)), own)]
    gap = paragraph_gap(lines, base)
    lone, areas, overused = isolated(lines, base, gap), margins(lines), R.overused_levels(lines, roles)
    t = _Text()
    page, above, before_x = 0, FAR, 0.0
    list_x: float | None = None
    dotted = False
    waiting = {p: list(ts) for p, ts in tables.items()}

    def insert(p: int, y: float) -> None:
        for entry in [e for e in waiting.get(p, []) if e[0] > y]:
            waiting[p].remove(entry)
            t.block("\n" + entry[1] + "\n")

    def turn(to: int) -> None:
        nonlocal page, above, before_x
        for p in sorted({page, *(q for q in waiting if page < q < to)} if page else {q for q in waiting if q < to}):
            insert(p, -FAR)
            t.close()
            t.out.append("\n\n")
        page, above, before_x = to, FAR, 0.0
        if options.numbers:
            t.out.append(f"<!-- Page {to} -->\n\n")

    for k, x in enumerate(lines):
        if x["page"] != page:
            turn(x["page"])
        insert(page, x["y"])
        plain = x["text"].strip()
        words = plain.split()
        first_x = x["items"][0]["x"] if x["items"] else 0.0
        all_bold = bool(x["items"]) and all(i.get("bold") for i in x["items"])
        if t.paragraph and options.bold and all_bold and len(words) <= 15:
            t.close(False)
        step = above - x["y"]
        breaks = abs(step) > gap
        switches = page in bands and not breaks and abs(before_x - first_x) > 50 and above < FAR
        if (breaks or switches) and t.paragraph:
            t.out.append("\n\n")
            t.paragraph = False
        if breaks and t.quote:
            t.out.append("\n")
            t.quote = False
        above, before_x = x["y"], first_x
        text = R.styled_text(x["items"], x["threshold"], options.bold, options.italic).strip() if options.bold or options.italic else plain
        if not text:
            continue
        role = R.line_role(x, roles.get(page, {}))
        code = role == "Code" or options.code and any(is_code_font(i.get("font") or "") for i in x["items"])
        if t.code and not code:
            t.out.append("```\n")
            t.code = False
        if role == "Caption" or is_caption(plain):
            t.block(text + "\n\n")
            continue
        # a line that goes on with a list item is no heading, however it is set
        goes_on = list_x is not None and list_x - 5 <= first_x <= list_x + 50 and 0 <= step <= gap and not is_item(plain)
        level = R.HEADINGS.get(role or "")
        level = None if level in overused else level
        if level is None and options.headers and not goes_on and len(plain.encode()) > 3 and len(words) <= 15 and not has_bullet(plain):
            size = R.line_size(x) or base
            level = R.size_level(size, base, tiers)
            if level is None and size >= 0.95 * base and len(words) >= 2 and not t.paragraph:
                rare = R.rarity(size, counts)
                score = 0.5 * rare + 0.3 * all_bold + 0.2 + 0.3 * (k in lone)
                if score >= 0.5 and (all_bold or k in lone or rare >= 0.97 and len(words) <= 8):
                    level = R.bold_level(tiers)
        if level:
            t.block("#" * level + " " + plain + "\n\n")
            list_x = None
            continue
        item = options.lists and is_item(plain)
        if item or role == "LI" and list_x is None and not is_item(plain):
            t.block((list_item(text) if item else f"- {text}") + "\n")
            list_x = first_x
            continue
        if list_x is not None:
            if list_x - 5 <= first_x <= list_x + 50 and step < 7 * base and not is_item(plain) and not has_leaders(plain):
                if t.out and t.out[-1].endswith("\n"):
                    t.out[-1] = t.out[-1][:-1] + " "
                t.out.append(text + "\n")
                continue
            list_x = None
        if role == "BlockQuote":
            t.block(f"> {text}\n")
            continue
        left, width, clear = areas.get(page, (0.0, 0.0, False))
        if options.centred and page in areas and R.is_centred(x, left, width):
            t.block(f"<center>{text}</center>\n\n")
            continue
        if options.quotes and page in areas:
            if clear and first_x > left + 3 * base:
                if not t.quote:
                    t.close()
                    t.quote = True
                t.out.append(f"> {text}\n")
                continue
            if t.quote:
                t.out.append("\n")
                t.quote = False
        if code:
            if not t.code:
                t.block("```\n")
                t.code = True
            t.out.append(plain + "\n")
            continue
        leaders = has_leaders(plain)
        if t.paragraph:
            t.out.append("\n" if leaders or dotted else " ")
        t.out.append(text)
        t.paragraph, dotted = True, leaders
    if page:
        insert(page, -FAR)
    for p in sorted(q for q in waiting if q > page):
        insert(p, -FAR)
    t.close()
    return cleaned("".join(t.out), options)


def is_page_number_line(t: str) -> bool:
    t = t.strip()
    return re.fullmatch(r"[0-9]{1,4}|[0-9]+\s* of \s*[0-9]+|-\s*[0-9]+\s*-", t) is not None or re.match(r"page\s*(of$|of |[0-9]|$)", t.lower()) is not None


def cleaned(text: str, options: Options = Options()) -> str:
    """Dot leaders, hyphens, page numbers, URLs, spaces and empty lines, in this order; ends with one line feed."""
    text = re.sub(r"\.{4,}", " ... ", text)
    if options.hyphens:
        text = re.sub(f"([{HYPHEN_LETTERS}]) - ([{HYPHEN_LETTERS}])", r"\1-\2", text)
    if options.page_numbers:
        lines = text.removesuffix("\n").split("\n")
        edge = lambda k: not 0 <= k < len(lines) or lines[k].strip() in ("", "---")
        text = "\n".join(x for k, x in enumerate(lines) if not (is_page_number_line(x) and edge(k - 1) and edge(k + 1)))
    if options.urls:
        text = re.sub(r"(?<!\]\()(?<!\[)(?<!<)(https?://[^\s<>)\]]+[^\s<>)\].,;])", r"[\1](\1)", text)
    text = re.sub(r"(?m)(?<=\S) {2,}", " ", text).lstrip("\n")
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


# ---- documents ---------------------------------------------------------------------------------------------------------


def layouts(pages: list[dict], base: float, tables: list) -> list[dict]:
    out: list[dict] = []
    for n, p in enumerate(pages, 1):
        out.append(page_layout(p, base, tables, n, out[-1]["grid"] if out else None))
    return out


def complexity(pages: list[dict], found: list[dict]) -> dict:
    """Pages with tables (contents don't count) and pages with several columns."""
    with_tables = [n for n, x in enumerate(found, 1) if any(kind == "Data" for _, _, kind, _ in x["tables"])]
    with_columns = [n for n, p in enumerate(pages, 1) if len(R.columns(p["items"], n in with_tables)) > 1]
    return {"is_complex": bool(with_tables or with_columns), "pages_with_tables": with_tables, "pages_with_columns": with_columns}


def base_of(pages: list[dict]) -> float:
    return body_size(size_counts([i["font_size"] for p in pages for i in p["items"]]))


def document_markdown(pages: list[dict], options: Options = Options(), tables: list = (), found: list[dict] | None = None) -> str:
    """The markdown of all pages as one text. Tags count if half of the items have one."""
    base = options.base or base_of(pages)
    found = found if found is not None else layouts(pages, base, list(tables))
    lines = [x for n, (p, f) in enumerate(zip(pages, found), 1) for x in page_lines(p, f, n)]
    items = [(n, i) for n, p in enumerate(pages, 1) for i in p["items"]]
    tagged = sum(pages[n - 1].get("roles", {}).get(i.get("mcid")) is not None for n, i in items)
    roles = {n: p["roles"] for n, p in enumerate(pages, 1) if p.get("roles")} if items and 2 * tagged >= len(items) else None
    by_page = {n: [e[:2] for e in f["tables"]] for n, f in enumerate(found, 1) if f["tables"]}
    whole = {n for n in by_page} - {x["page"] for x in lines}
    by_page = merge_continued(by_page, whole)
    if options.repeated:
        lines = without_running(lines, len(pages) + 1)
    return to_markdown(lines, options, by_page, {n for n, f in enumerate(found, 1) if f["bands"]}, roles)

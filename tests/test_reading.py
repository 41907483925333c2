"""Reading order and tables of pages, against small pages by hand."""

import io
import struct

import pytest

from quirelake.operators import assemble as A, page_tables as T, reading as R
from quirelake.plans.page_queries import pdf_file, show
from quirelake.sources import glyphs, pdf


def item(text, x=0.0, y=0.0, width=None, size=10.0, **more):
    return {"text": text, "x": float(x), "y": float(y), "width": float(len(text) * 5 if width is None else width), "font": "F", "font_size": float(size)} | more


@pytest.mark.parametrize(
    ("a", "b", "joined"),
    [
        (item("hel"), item("lo", 15.5), True),
        (item("hello"), item("world", 27.5), False),
        (item("www"), item(".com", 17), True),
        (item("Key:"), item("T9", 20), False),
        (item("34,20"), item("8", 27), True),
        (item("b"), item("illion", 6.9), True),
        (item("b"), item("ig", 7.5), False),
        (item("a "), item("b", 10), False),
        (item("left"), item("right", 90), False),
        (item("LCOE"), item("WITH", 21.6), False),
        (item("enterta"), item("inment", 36.7), True),
        (item("CONST", width=0), item("ANCIA", 24), True),
        (item("presente", width=0), item("CONSTANCIA", 36), False),
        (item("漢", width=0), item("字", 6), True),
    ],
)
def test_should_join(a, b, joined):
    assert R.should_join(a, b) is joined


def test_lines_and_spaces():
    assert R.line_text([item("H"), item("2", 5.2, -3, size=6), item("O", 8.5)]) == "H2O"
    assert R.line_text([item("well-"), item("known", 27)]) == "well-known"
    assert R.styled_text([item("all", bold=True), item("bold", 18, bold=True), item("not", 45), item("so", 63, italic=True)]) == "**all bold** not *so*"
    assert R.effective_font_size(12, (0, 2, -2, 0, 5, 5)) == 24 and R.effective_width(item("abcd", width=0)) == 20


def test_letter_spacing():
    spaced = [item(t, 60 * k) for k, t in enumerate(["p r o g r a m", "n o t e s", "i n", "a l l", "t h e s e"])]
    assert [i["text"] for i in R.close_letterspaced(spaced)[0]] == ["program", "notes", "in", "all", "these"]
    one = [item("p r é s e n t e"), item("A B C D E F", 100), *[item("plain words", 0, -20 * k) for k in range(6)]]
    assert [i["text"] for i in R.close_letterspaced(one)[0]][:2] == ["présente", "A B C D E F"]
    letters = [item(c, 11 * k, width=5) for k, c in enumerate("letterbyletter")]
    assert R.close_letterspaced(letters)[1] == pytest.approx(0.93) and R.letterspaced_threshold(letters[:5]) == R.TIGHT
    gaps = [0, 11, 22, 33, 50, 61, 72, 83, 100, 111, 122]
    assert 0.6 < R.two_class_threshold([item("a", x, width=5) for x in gaps]) < 1.2


def test_merging():
    got = R.merge_items([item("Hel", 0, 700), item("lo", 15.2, 700.5), item("world", 28, 700), item("far", 200, 700), item("below", 0, 680)])
    assert [i["text"] for i in got] == ["Hello world", "far", "below"]
    got = R.merge_subscripts([item("CO", 0, 0), item("2", 10.5, -2, size=6), item("33", 40, 0), item("1", 50.5, 3, size=6)])
    assert [i["text"] for i in got] == ["CO2", "33", "1"]


def page(left, right, at=(50, 330), chars=40):
    return [item(f"{t} {k:02d}".ljust(chars, "x"), x, 700 - 14 * k) for t, x, n in (("left", at[0], left), ("right", at[1], right)) for k in range(n)]


def test_columns_are_read_one_by_one():
    items = page(20, 18) + [item("A title over the whole of the page".ljust(100, "x"), 50, 730)]
    assert len(R.columns(items)) == 2
    lines = R.page_reading(items)
    assert lines[0]["text"].startswith("A title") and [x["text"][:4] for x in lines[1:]] == ["left"] * 20 + ["righ"] * 18
    rows = R.page_reading(page(12, 12))
    assert len(rows) == 12 and all("left" in x["text"] and "right" in x["text"] for x in rows)
    assert len(R.columns(page(6, 6))) == 1 and R.columns([]) == []
    assert R.is_page_number(item("12", 300, 50)) and not R.is_page_number(item("12", 300, 400))


def test_columns_without_clear_valleys():
    crossing = [item("y" * 70, 50, 100 - 14 * k, 420) for k in range(2)]
    assert len(R.columns(page(20, 20) + crossing)) == 2
    assert R.widest_gap(page(20, 8, (50, 300)), 50, 500)[0][1] == pytest.approx(275)
    assert R.widest_gap(page(20, 20, (50, 255)), 50, 455) == []
    bins = R.np.array([30] * 40 + [9] * 4 + [30] * 40)
    assert R.relative_valleys(bins, 168.0) and not R.relative_valleys(R.np.array([30] * 84), 168.0)


def test_spanning_and_stragglers():
    items = page(8, 8) + [item("a wide line", 50, 760, 240), item("that goes on", 291, 760, 220)]
    cols = [(50.0, 290.0), (290.0, 530.0)]
    assert [i for i, m in enumerate(R.spanning(items, cols)) if m] == [16, 17]
    assert R.crosses(item("x", 100, 0, 300), cols) and not R.crosses(item("x", 100, 0, 100), cols)
    lines = [{"y": y} for y in (700, 690, 680, 670, 500, 490)]
    core, rest = R.part_stragglers(lines)
    assert [x["y"] for x in core] == [700, 690, 680, 670] and [x["y"] for x in rest] == [500, 490]


def test_side_by_side():
    two = [item("word here", x + 60 * c, 700 - 15 * k, 40) for k in range(12) for x in (50, 380) for c in range(2)]
    (a, b), (c, d) = R.side_by_side(two)
    assert b == c and 150 < b < 380
    numbers = [item("label", 50, 700 - 15 * k, 40) for k in range(25)] + [item("1,200", 380, 700 - 15 * k, 40) for k in range(25)]
    assert R.side_by_side(numbers) == [] == R.side_by_side(two[:30])
    assert R.in_band([(0, 0, 50, 5), (0, 0, 500, 5), (300, 0, 20, 5)], 0, 100) == [(0, 0, 50, 5)]
    assert R.segments_in_band([(0, 0, 50, 0), (200, 0, 300, 0)], 0, 100) == [(0, 0, 50, 0)]


def line(text, y, size=10.0, x=50.0, page=1, **more):
    return R._line([item(text, x, y, size=size, **more)], y, R.TIGHT) | {"page": page}


def test_headings():
    assert R.heading_level(line("t", 0, 18), 10, [18.2, 14]) == 1 and R.heading_level(line("t", 0, mcid=3), 10, [], {3: "H4"}) == 4
    assert [R.bold_level(t) for t in ([], [20.0], [20.0] * 6)] == [2, 2, 6]
    assert R.rarity(10, {100: 3, 180: 1}) == 0.25 and R.rarity(9, {}) == 0.0
    merged = R.merge_headings([line("A long", 700, 20), line("title", 678, 20), line("body", 640)], 10, [20.0])
    assert [x["text"] for x in merged] == ["A long title", "body"]
    capped = R.merge_drop_caps([line("Heading", 720), line("nce upon", 700), line("a time", 686), line("O", 690, 30)], 10)
    assert [x["text"] for x in capped] == ["Heading", "Once upon", "a time"]
    assert R.is_centred(line("middle", 0, x=250), 50, 430) and not R.is_centred(line("left", 0), 50, 430)
    tagged = [line(f"l{k}", -k, mcid=k) for k in range(20)]
    assert R.overused_levels(tagged, {1: {k: "H2" if k < 10 else "P" for k in range(20)}}) == {2}


def test_markdown_of_lines():
    lines = [line("A Big Title", 760, 20), *[line(f"word {k} of the text goes on", 700 - 14 * k) for k in range(6)], line("• first point", 580), line("goes on here", 566, x=55), line("2) second", 552), line("Figure 1 shows it", 500), line("print(x)", 400, font="Courier"), line("x = 1", 388, font="Courier")]
    text = A.to_markdown(lines, A.Options(), {1: [(520.0, "|a|b|\n|---|---|\n|1|2|\n")]})
    assert text.startswith("# A Big Title\n\nword 0 of the text goes on word 1") and "- first point goes on here\n2) second\n\n|a|b|" in text
    assert "\n\nFigure 1 shows it\n\n" in text and text.endswith("```\nprint(x)\nx = 1\n```\n")
    alone = [line(f"some body text {k}", 700 - 14 * k) for k in range(8)] + [line("Acknowledgements part", 540), *[line(f"more body text {k}", 490 - 14 * k) for k in range(8)]]
    assert "\n## Acknowledgements part\n" in A.to_markdown(alone, A.Options())
    assert A.to_markdown([], A.Options()) == ""


def test_running_lines():
    lines = [x for p in range(1, 6) for x in (line(f"The annual report {p}", 780, page=p), *[line(f"text {p} {k}", 700 - 14 * k, page=p) for k in range(12)])]
    left = A.without_running(lines, 5)
    assert [x["text"] for x in left if "annual" in x["text"]] == ["The annual report 1"] and len(left) == len(lines) - 4


def test_continued_tables():
    t = lambda *rows: [(700.0, "|a|b|\n|---|---|\n" + "".join(f"|{r}|x|\n" for r in rows))]
    got = A.merge_continued({1: t(1, 2), 2: t(3), 4: t(5), 5: [(1.0, "|a|b|c|\n|---|---|---|\n|1|2|3|\n")]}, {1, 2, 4, 5})
    assert got[1][0][1].count("\n") == 5 and sorted(got) == [1, 4, 5]
    assert sorted(A.merge_continued({1: t(1), 2: t(2)}, {1})) == [1, 2]


def test_a_grid_goes_on_with_one_row():
    edges, file = (60, 180, 300, 460), lambda pages: pdf_file([b"".join(b"%d %d %d 20 re S\n" % (a, 710 - 20 * r, b - a) for r in range(len(rows)) for a, b in zip(edges, edges[1:])) + b"".join(show(edges[c] + 4, 714 - 20 * r, t) for r, row in enumerate(rows) for c, t in enumerate(row)) for rows in pages])
    head, rows = ["key", "name", "value"], [[f"k{r}", f"name{r}", f"v{r}"] for r in range(31)]
    line = lambda r: "|" + "|".join(r) + "|\n"
    text = pdf.process(file([[head, *rows[:30]], [head, rows[30]]]), options=A.Options())["markdown"]
    assert text == line(head) + "|---|---|---|\n" + "".join(map(line, rows))
    # two rows that repeat no header go on from nothing, and stand for themselves
    assert "|other" not in pdf.process(file([[head, *rows[:30]], [["other", "name", "value"], rows[30]]]), options=A.Options())["markdown"]
    assert "|" not in pdf.process(file([[head, rows[30]]]), options=A.Options())["markdown"]


# ---- tables --------------------------------------------------------------------------------------------------------------


def test_numbers_in_items():
    assert [i["text"] for i in T.split_financial(item("$ 1,200 114 — (5)", 0, 0, 300))] == ["$ 1,200", "114", "—", "(5)"]
    assert T.split_financial(item("Land $ 778 12 9", 0, 0, 300)) is None and T.split_financial(item("1 2 3", 0, 0, 100)) is None
    assert [(i["text"], i["x"]) for i in T.split_numbers(item("10 11 Holiday", 21, 0, 60), [0, 20, 40, 60])] == [("10", 20), ("11", 40), ("Holiday", 40)]


def test_what_cells_say():
    assert T.consistent_columns([["a", "b", ""]] * 4) and not T.consistent_columns([["x"] * k + [""] * (12 - k) for k in (0, 4, 8, 12)])
    assert T.table_content([["h", "h"], ["a", "1"], ["b", "2"]], False) and not T.table_content([["h", "h"], ["a" * 40, "b" * 40]], True)
    assert T.is_paragraph([["some words that are cut-", "x"], ["a", "b"]]) and not T.is_paragraph([["a", "1"], ["b", "2"], ["c", "3"]])
    assert T.is_paragraph([["l e t t e r s p", "x"], ["a", "b"]])
    assert T.kind_of([["Intro", "....", "3"], ["Body", "....", "7"]]) == "Toc" and T.kind_of([["a", "b"], ["1", "2"]]) == "Data"
    assert T.kind_of([["1.1 One", "3"], ["1.2 Two", "4"], ["2.1 Three", "9"], ["2.2 Four", "11"]]) == "Toc"
    assert T.contents_lines([["Intro", "....", "3"], ["", "", ""], ["Part", "A-1", ""]]) == "Intro\t3\nPart\tA-1\n"
    assert not T.is_key_value([["Ann", "x", ""], ["Bob", "4", ""], ["Cid", "z", ""]]) and T.is_key_value([["NAME", "x", ""], ["Age:", "4", ""]])


def test_partial_tables():
    table = lambda head, *rows: "|" + "|".join(head) + "|\n|" + "---|" * len(head) + "\n" + "".join("|" + "|".join(r) + "|\n" for r in rows)
    assert not T.is_partial(table(["a", "b", "c"], ["1", "2", "3"])) and T.is_partial("|a|b|\n|1|2|\n")
    assert T.is_partial(table(["2024", "b", "c"], ["1", "2", "3"])) and not T.is_partial(table(["2024", "b", "c"], ["1", "2", "3"]), True)
    assert T.is_partial(table(["a", "", "c"], ["1", "2", "3"])) and T.is_partial(table(["a", "a"], ["1", "2"]))
    assert T.is_partial(table(["a", "b", "c"], ["1", "", ""]), True) and T.is_partial(table(["a", "b"], *[["and so", "on it"]] * 4))


GRID = [item(f"{c}{r}", 20 + 100 * c, 95 - 20 * r, 20) for r in range(3) for c in range(3)]
CELLS = [(10 + 100 * c, 90 - 20 * r, 100, 20) for r in range(3) for c in range(3)]


def test_rect_tables():
    tables, hints = T.rect_tables(GRID, CELLS)
    assert [t["cells"] for t in tables] == [[["00", "10", "20"], ["01", "11", "21"], ["02", "12", "22"]]] and hints == []
    merged = [r for r in CELLS if r[0] != 10 or r[1] not in (70, 50)] + [(10, 50, 100, 40)]
    assert T.rect_tables(GRID, merged)[0][0]["cells"] == [["00", "10", "20"], ["01 02", "11", "21"], ["", "12", "22"]]
    stripes = [(10, 90 - 20 * r, 300, 20) for r in range(3)]
    assert T.stripe_table(GRID, stripes)["cells"][2] == ["02", "12", "22"] and T.stripe_table(GRID, CELLS) is None
    assert T.rect_tables(GRID, [])[0] == [] and T.grid_table([], CELLS) is None
    assert len(T.split_wide(CELLS + [(x + 400, y, w, h) for x, y, w, h in CELLS])[0]) == 9
    assert len(T.usable([*CELLS, (12, 92, 90, 16), (0, 0, 2, 2), (0, 0, 5000, 20)])) == 9


def test_hints_and_guided_tables():
    days = [(20 * c, 100 - 20 * r, 18, 18) for r in range(5) for c in range(7)]
    numbers = [item("1 2 3 4 5 6 7", 2, 104, 130), item("8 9 10 11 12 13 14", 2, 84, 130)]
    got = T.guided_table(numbers, days)
    assert got["cells"][:2] == [list("1234567"), ["8", "9", "10", "11", "12", "13", "14"]]
    far = [(x + 300, y, w, h) for x, y, w, h in days]
    wide = [*days, *far, *[(x, y + up, w, h) for x, y, w, h in [*days, *far] for up in (200, 400)]]
    assert T.hint_bands([item("a", 0), item("b", 440)], [(x, y, 22, 22) for x, y, *_ in wide]) and T.hint_bands(numbers, days) == []


def test_text_tables():
    rows = [["Name", "Size", "Count"], ["alpha", "12", "7"], ["beta", "14", "9"], ["gamma", "18", "11"], ["delta", "20", "30"]]
    items = [item(t, 50 + 120 * c, 700 - 15 * r) for r, row in enumerate(rows) for c, t in enumerate(row)]
    assert [t["cells"] for t in T.text_tables(items, 10)] == [rows]
    assert T.text_tables([item("running text of a paragraph", 50, 700 - 15 * r) for r in range(10)], 10) == []
    small = [i | {"font_size": 8.0} for i in items[3:]]
    assert T.text_tables(small + items[:3], 10)[0]["cells"] == rows  # the header is of body size
    assert T.column_alignment(items, [50, 170, 290], True) == 1.0 and T.row_bounds(items) == [700, 685, 670, 655, 640]
    assert [round(c) for c in T.column_bounds(items, True)] == [50, 170, 290]


def test_labels_beside_numbers():
    items = [item(t, x, 700 - 15 * r, size=8) for r in range(6) for t, x in ((f"label {r}", 50), (str(1200 + r), 250), (str(77 + r), 350))]
    t = T.table([250, 350], [700 - 15 * r for r in range(6)], [[str(1200 + r), str(77 + r)] for r in range(6)], [k for k in range(18) if k % 3])
    got = T.add_labels(t, items, list(range(18)), set())
    assert got["cells"][2] == ["label 2", "1202", "79"] and len(got["items"]) == 18
    assert T.add_labels(t, items, list(range(18)), {k for k in range(18) if k % 3 == 0}) == t


def test_kinds_of_documents():
    text = {"text_ops": 60, "images": 0, "pixels": [], "signs": set(range(97, 120)), "path_ops": 0, "items": [{"known": True}]}
    scan = text | {"text_ops": 4, "images": 1, "pixels": [900_000], "signs": set(range(97, 103))}
    drawn = text | {"text_ops": 1, "path_ops": 5000, "signs": {97}}
    kind = lambda *pages: pdf.classify(list(pages))
    assert kind(text, text) == ("TextBased", 1.0, []) and kind(text, scan) == ("Mixed", 0.65, [2])
    assert kind(drawn, drawn) == ("ImageBased", 0.8, [1, 2]) and kind(text | {"text_ops": 0, "images": 1, "signs": set()}) == ("Scanned", 0.95, [1])
    assert kind(text, drawn, drawn) == ("Mixed", 0.7, [2, 3]) and kind(text | {"text_ops": 2, "signs": {97}}) == ("TextBased", 0.5, [])


def test_tagged_tables():
    items = [item(t, x, y, mcid=k) for k, (t, x, y) in enumerate([("h1", 50, 700), ("h2", 150, 700), ("a", 50, 680), ("b", 150, 680), ("only right", 150, 660)])]
    cell = lambda k: {"header": False, "mcids": [(k, 1)]}
    tables = [[[cell(0), cell(1)], [cell(2), cell(3)], [cell(4)]]]
    got = T.tagged_tables(items, tables, 1)
    assert got[0]["cells"] == [["h1", "h2"], ["a", "b"], ["", "only right"]] and T.tagged_tables(items, tables, 2) == []


def test_structure_of_a_model():
    tokens = ["<thead>", "<tr>", "<td></td>", "<td></td>", "</tr>", "</thead>", "<tr>", "<td></td>", "<td></td>", "</tr>"]
    boxes = [[0, 0, 100, 22], [100, 0, 200, 22], [0, 18, 100, 40], [100, 18, 200, 40]]
    cells = T.structured(tokens, boxes, 72, (50, 92))
    assert [c["header"] for c in cells] == [True, True, False, False] and cells[0]["box"][3] == cells[2]["box"][1] == 112
    items = [item("left", 60, 685, 20, 8), item("right", 160, 685, 20, 8), item("low", 60, 665, 20, 8), item("out", 252, 665, 20, 8)]
    full = T.fill_cells(cells, items, 792)
    assert [c["text"] for c in full] == ["left", "right", "low", "out"]
    assert T.cells_markdown(full) == "|left|right|\n|---|---|\n|low|out|\n" and T.structure_issue(full, items, 792) is None
    gone = [c | {"text": ""} if c["row"] == 1 else c for c in full] + [c | {"row": 2} for c in full[2:]]
    assert T.structure_issue(gone, items, 792) == "phantom_empty_row"
    tall = [full[0] | {"box": (50, 92, 150, 132), "text": "left low"}]
    assert T.structure_issue(tall, [items[0], items[2] | {"y": 661.0}], 792) == "multi_row_in_cell"
    assert T.region_text(items, (50, 92, 150, 140), 792) == "left\nlow" and not T.is_rotated(items)


def test_layout():
    p = {"items": GRID + [item("below the table stands text", 10, 20)], "rects": CELLS, "segments": [], "threshold": 0.1}
    found = A.layouts([p], 10, [])
    assert A.complexity([p], found) == {"is_complex": True, "pages_with_tables": [1], "pages_with_columns": []}
    assert A.document_markdown([p], found=found).startswith("|00|10|20|\n|---|---|---|\n|01|11|21|")


# ---- files ---------------------------------------------------------------------------------------------------------------


def test_glyphs():
    named = {"A": "A", "eacute": "é", "Scaron": "Š", "seven": "7", "zero.tf": "0", "uni20AC": "€", "u1F600": "😀", "alpha": "α", "Omegatonos": "Ώ", "afii10017": "А", "afii10071": "ё", "f_i": "fi", "quoteright": "’", "uniF041": "A", "g12x": None}
    assert {k: glyphs.glyph_char(k) for k in named} == named
    assert [glyphs.korean_char(c) for c in (1, 34, 1086, 1087, 3435, 3436, 9000)] == [" ", "A", "가", "각", "힝", "伽", None]
    assert glyphs.is_garbage("�") and not glyphs.is_garbage("a")


def truetype(pairs):
    groups = b"".join(struct.pack(">LLL", c, c, g) for c, g in pairs)
    cmap = struct.pack(">HHHHL", 0, 1, 3, 10, 12) + struct.pack(">HHLLL", 12, 0, 16 + len(groups), 0, len(pairs)) + groups
    return struct.pack(">LHHHH", 0x10000, 1, 16, 0, 0) + b"cmap" + struct.pack(">LLL", 0, 28, len(cmap)) + cmap


def test_fonts_without_a_map():
    assert glyphs.truetype_chars(truetype([(65, 3), (66, 4), (97, 3)])) == {3: "A", 4: "B"} and glyphs.truetype_chars(b"x") == {}
    n = 6
    part = lambda *v: struct.pack(f">{len(v)}H", *v)
    four = part(4, 32, 0, 4, 0, 0, 0) + part(67, 0xFFFF) + part(0) + part(65, 0xFFFF) + part((3 - 65) & 0xFFFF, 1) + part(0, 0)
    font = struct.pack(">LHHHH", 0x10000, 1, 16, 0, 0) + b"cmap" + struct.pack(">LLL", 0, 28, 12 + len(four)) + part(0, 1, 3, 1) + struct.pack(">L", 12) + four
    assert glyphs.truetype_chars(font) == {3: "A", 4: "B", 5: "C"} and n
    raw = truetype([(72, 5), (105, 6)])
    more = [b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [5001 0 R] >>", b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 /FontDescriptor 5002 0 R >>", b"<< /FontFile2 5003 0 R >>", b"<< /Length %d >>\nstream\n" % len(raw) + raw + b"\nendstream"]
    page_ = b"BT /F2 10 Tf 72 700 Td <00050006> Tj ET"
    d = pdf.Document(pdf_file([page_], [b"/Resources << /Font << /F2 5000 0 R >> >>"], more).replace(b"/Resources << /Font << /F1 3 0 R >> >> ", b""))
    assert [i["text"] for i in pdf.page_items(d, d.pages()[0])["items"]] == ["Hi"]


def test_names_of_glyphs_in_an_encoding():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [65 /eacute /germandbls 70 /fi] >> >>"
    d = pdf.Document(pdf_file([b"BT /F2 10 Tf 72 700 Td (ABF) Tj ET"], [b"/Resources << /Font << /F2 5000 0 R >> >>"], [font]).replace(b"/Resources << /Font << /F1 3 0 R >> >> ", b""))
    assert [i["text"] for i in pdf.page_items(d, d.pages()[0])["items"]] == ["éßfi"]


def test_turned_pages_and_clips():
    turned = b"".join(b"BT /F1 10 Tf 0 1 -1 0 %d 100 Tm (line %d of it) Tj ET\n" % (100 + 20 * k, k) for k in range(4))
    p = pdf.content(pdf.Document(pdf_file([turned])))[0]
    assert p["is_turned"] and [i["text"] for i in p["items"]] == [f"line {k} of it" for k in range(4)]
    assert pdf.distinct_rects([(0, 0, 10, 10), (0.1, 0.2, 10, 10), (50, 0, 10, 10)]) == [(0, 0, 10, 10), (50, 0, 10, 10)]
    clips = b"".join(b"%d 100 50 20 re W n\n" % (50 * k) for k in range(5)) + show(72, 105, "x")
    assert len(pdf.content(pdf.Document(pdf_file([clips])))[0]["rects"]) == 5


def test_bare_names_of_tags():
    raw = pdf_file([b"/P << /MCID 0 >> BDC " + show(72, 700, "Some heading words") + b" EMC"], None, [b"<< /Type /StructTreeRoot /K 5001 0 R >>", b"<< /S H2 /Pg 10 0 R /K 0 >>"], b"/StructTreeRoot 5000 0 R")
    assert pdf.structure(pdf.Document(raw))[0] == {1: {0: "H2"}} and "## Some heading words" in pdf.process(raw)["markdown"]
    assert pdf.standard_role("Kopf", {"Kopf": "Titel", "Titel": "H1"}) == "H1" and pdf.standard_role("x", {"x": "y", "y": "x"}) == "x"


def test_pages_and_regions():
    raw = pdf_file([show(72, 700, "the first page says this") + show(72, 687, "and this"), b""])
    pages = pdf.pages_markdown(raw)
    assert [(p["page"], p["needs_ocr"]) for p in pages] == [(1, False), (2, True)] and pages[0]["markdown"] == "the first page says this and this\n"
    assert [p["needs_ocr"] for p in pdf.pages_markdown(raw, [1, 9])] == [False, True]
    assert pdf.region_texts(raw, 1, [(60, 80, 300, 92), (400, 0, 500, 50)]) == [{"text": "the first page says this", "needs_ocr": False}, {"text": "", "needs_ocr": True}]
    rows = [["Name", "Size", "Count"], ["alpha", "12", "7"], ["beta", "14", "9"], ["gamma", "18", "11"]]
    table = pdf_file([b"".join(show(50 + 120 * c, 700 - 15 * r, t) for r, row in enumerate(rows) for c, t in enumerate(row))])
    assert pdf.region_tables(table, 1, [(40, 80, 400, 160)])[0]["text"].startswith("|Name|Size|Count|\n|---|---|---|\n|alpha|12|7|")
    got = pdf.structured_tables(table, [{"page": 1, "tokens": ["<tr>", "<td></td>", "<td></td>", "</tr>"], "boxes": [[0, 0, 100, 20], [110, 0, 300, 20]], "dpi": 72, "region": (45, 78, 400, 98)}])
    assert got[0]["markdown"].startswith("|Name|Size") and pdf.structured_tables(table, [{"page": 7}])[0]["cells"] == []


def test_cid_garbage_and_sparse_pages():
    assert pdf.is_garbage_text("§$%&/()=?" * 8) and not pdf.is_garbage_text("words and words " * 8)
    assert pdf.is_cid_garbage("\x81\x82\x83abc") and pdf.has_encoding_issues("a�b")
    few = pdf.process(pdf_file([show(72, 700, "only"), show(72, 700, "few words"), show(72, 700, "ab")]))
    assert few["pages_needing_ocr"] == [1, 2, 3]
    assert io.BytesIO(pdf_file([b""])).read(5) == b"%PDF-"

"""Positioned texts: lines, columns, running headers, classes and tables."""

from quirelake.operators import page_tables as T, pages as P, reading as R


def item(text, x, y, width=30.0, size=10.0, **more):
    return {"text": text, "x": float(x), "y": float(y), "width": width, "font": "F", "font_size": size} | more


def test_lines():
    got = R.line_up([item("a", 10, 100, 5), item("b", 40, 101, 5), item("c", 10, 80, 5)])
    assert [x["text"] for x in got] == ["a b", "c"] and len(got[0]["items"]) == 2
    assert R.line_up([item("ab", 10, 100, 10), item("c", 20.5, 100, 5)])[0]["text"] == "abc"


def test_columns():
    two = [item("w", x, 700 - 12 * i, 150) for i in range(15) for x in (50, 330)]
    assert len(R.columns(two)) == 2 and len(R.columns(two[:6])) == 1 and R.columns([]) == []


def test_running_headers(spark):
    rows = [(1, p, n, t, 0.0, y, 9.0, 10.0, 1) for p in range(1, 7) for n, (t, y) in enumerate([(f"Report {p}", 780.0), *((f"text {p} {i} x", 700.0 - i) for i in range(8)), (f"{p}", 30.0)])]
    lines = spark.createDataFrame(rows, "doc_id int, page int, line_no int, text string, x double, y double, x2 double, font_size double, items int")
    left = P.without_repeated_lines(lines).where("text like 'Report%'").collect()
    assert [r["page"] for r in left] == [1]
    assert P.without_repeated_lines(lines).count() == len(rows) - 5
    assert P.body_size(lines).first()["base"] == 10.0


def test_classes(spark):
    df = spark.createDataFrame([(1, 1, 50, 0, 30), (1, 2, 40, 0, 30), (2, 1, 0, 1, 0), (3, 1, 1, 0, 2), (4, 1, 5, 2, 9)], "doc_id int, page int, text_ops int, images int, distinct_chars int")
    got = {r["doc_id"]: (r["classification"], r["confidence"], r["pages_needing_ocr"]) for r in P.classified(df).collect()}
    assert got == {1: ("TextBased", 1.0, []), 2: ("Scanned", 0.95, [1]), 3: ("TextBased", 0.5, []), 4: ("Mixed", 0.7, [1])}


def test_tables():
    cells = [item(f"{c}{r}", 20 + 100 * c, 95 - 20 * r, 20) for r in range(3) for c in range(3)]
    rules = [(x, 40, x, 110) for x in (10, 110, 210, 310)] + [(10, y, 310, y) for y in (110, 90, 70, 50)]
    assert P.table_from_lines(cells, rules) == [["00", "10", "20"], ["01", "11", "21"], ["02", "12", "22"]]
    assert P.table_from_lines(cells, rules[:3]) is None and T.text_tables(cells[:4], 10) == []
    assert T.rule_table(cells, rules)["cells"][1] == ["01", "11", "21"]
    made = T.table([0, 1], [3, 2, 1, 0], [["a", "b"], ["1", "2"], ["", "3"], ["(1) note", ""]], [])
    assert T.markdown(made) == "|a|b|\n|---|---|\n|1|2 3|\n\n(1) note\n"
    assert T.is_key_value([["Name:", "x", ""], ["Age:", "4", ""], ["Town:", "z", ""]]) and not T.is_key_value([["1", "2", "3"]] * 3)
    got = P.structure_cells(["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>"])
    assert [(c["row"], c["col"], c["rowspan"]) for c in got] == [(0, 0, 2), (0, 1, 1), (1, 1, 1)]
    assert [R.size_level(s, 10, t) for s, t in ((18, [18.2, 14]), (14, [18, 14]), (20, []), (11, []), (13, []))] == [1, 2, 1, None, 3]


def test_pages_as_rows(spark):
    items = spark.createDataFrame([(1, 1, i, w, 10.0 + 40 * (i % 2), 700.0 - 20 * (i // 2), 30.0, "F", 10.0) for i, w in enumerate("abcdef")], "doc_id int, page int, idx int, text string, x double, y double, width double, font string, font_size double")
    assert [r["text"] for r in R.reading_lines(items).orderBy("line_no").collect()] == ["a b", "c d", "e f"]
    regions = spark.createDataFrame([(1, 1, 7, 0.0, 675.0, 45.0, 695.0)], "doc_id int, page int, region int, x1 double, y1 double, x2 double, y2 double")
    assert [r["text"] for r in P.items_in_regions(items, regions).orderBy("idx").collect()] == ["c"]


LINES = "doc_id int, page int, line_no int, text string, x double, y double, x2 double, font_size double, items int"


def test_paragraph_threshold_and_isolated_lines(spark):
    # a double-spaced document: gaps of 24 at size 10, one of 60 on each side of a short line
    ys = [700, 676, 652, 628, 568, 508, 484, 460]
    texts = ["Words that go on and on over the line"] * 8
    rows = [(1, 1, i, "Main Results" if i == 4 else t, 50.0, float(y), 300.0, 10.0, 1) for i, (t, y) in enumerate(zip(texts, ys))]
    rows += [(2, 1, i, "Alone here", 50.0, 700.0 - 60 * i, 300.0, 10.0, 1) for i in range(4)]
    lines = spark.createDataFrame(rows, LINES)
    got = {r["doc_id"]: (r["base"], round(r["threshold"], 6)) for r in P.paragraph_threshold(lines).collect()}
    assert got == {1: (10.0, 31.2), 2: (10.0, 18.0)}
    assert [(r["doc_id"], r["line_no"]) for r in P.isolated_lines(lines).collect()] == [(1, 4)]  # all of document 2's page would be


def test_page_margins(spark):
    one = [(1, 1, i, "t", x, 0.0, 500.0 + i, 10.0, 3) for i, x in enumerate([50.0, 51.0, 50.0, 59.0, 72.0])]
    two = [(1, 2, i, "t", x, 0.0, 500.0, 10.0, 3) for i, x in enumerate([50.0, 50.0, 300.0, 300.0])]
    few = [(1, 3, i, "t", 50.0, 0.0, 500.0, 10.0, n) for i, n in enumerate([3, 3, 2])]
    got = {r["page"]: tuple(r)[2:] for r in P.page_margins(spark.createDataFrame(one + two + few, LINES)).collect()}
    assert got == {1: (50.0, 504.0, 277.0, 454.0, 0.8, False), 2: (50.0, 500.0, 275.0, 450.0, 0.5, True)}


def test_rect_components(spark):
    chain = [(10.0 * i, 0.0, 9.0, 5.0) for i in range(2500)]
    assert P.cluster_rects(chain, 0.5, 2) == [list(range(2500))] and P.cluster_rects(chain, 0.4, 2) == []
    assert P.cluster_rects([(0, 0, 5, 5), (50, 0, 5, 5), (4, 4, 5, 5), (54, 20, 5, 5)], 0.0) == [[0, 2], [1], [3]] and P.cluster_rects([], 1.0) == []
    rects = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate([(0.0, 0.0, 5.0, 5.0), (50.0, 0.0, 5.0, 5.0), (4.0, 4.0, 5.0, 5.0)])], "doc_id int, page int, idx int, x double, y double, width double, height double")
    assert [(r["idx"], r["component"]) for r in P.rect_components(rects, 0.0, 2).orderBy("idx").collect()] == [(0, 0), (2, 0)]

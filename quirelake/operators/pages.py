"""Pages of positioned texts as rows: running headers, body sizes, margins, page classes, regions; and what tables are made of.

Lines are rows of reading.reading_lines; what counts over a document is a DataFrame aggregate, what compares with the state so
far (cells of a grid) runs on one page at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import is_caption_line, is_list_item, normalize_for_comparison


def without_repeated_lines(lines: DataFrame, share: float = 0.3, least: int = 3, edge: int = 3) -> DataFrame:
    """Lines without running headers and footers: those among the first or last three of a page whose text, numbers at its
    ends apart, stands on at least max(3, 30 %) of the pages at about the same height (a deviation of 5 points at most).
    The first page that has it keeps it."""
    last = lines.groupBy("doc_id", "page").agg(F.max("line_no").alias("last"))
    marked = lines.join(last, ["doc_id", "page"]).withColumn("norm", normalize_for_comparison(F.col("text")))
    marked = marked.withColumn("edge", (F.col("line_no") < edge) | (F.col("line_no") > F.col("last") - edge))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = marked.where("edge and norm <> ''").groupBy("doc_id", "norm").agg(F.count_distinct("page").alias("n"), F.stddev_pop("y").alias("spread"), F.min("page").alias("first"))
    running = seen.join(pages, "doc_id").where((F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))) & (F.col("spread") <= 5)).select("doc_id", "norm", "first")
    return marked.join(running, ["doc_id", "norm"], "left").where("first is null or not edge or page = first").select(*lines.columns)


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, base): the commonest font size of 9 points or more, in tenths; the smaller of equally common ones; else 12."""
    tenth = F.floor(F.col("font_size") * 10)
    n = lines.groupBy("doc_id", tenth.alias("t")).agg(F.count("*").alias("n"))
    best = n.groupBy("doc_id").agg(F.max_by("t", F.when(F.col("t") >= 90, F.struct("n", -F.col("t")))).alias("t"))
    return best.select("doc_id", F.coalesce(F.col("t") / 10, F.lit(12.0)).alias("base"))


def paragraph_threshold(lines: DataFrame) -> DataFrame:
    """(doc_id, base, threshold): the body size, and the gap over which a paragraph ends: the upper median of the gaps between
    a document's lines that are under 10 x base, x 1.3, at least 1.5 x base; with fewer than 5 gaps 1.8 x base."""
    gap = F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("line_no")) - F.col("y")
    gaps = lines.select("doc_id", gap.alias("gap")).join(body_size(lines), "doc_id")
    own = gaps.groupBy("doc_id", "base").agg(F.array_sort(F.collect_list(F.when((F.col("gap") > 0) & (F.col("gap") < F.col("base") * 10), F.col("gap")))).alias("gs"))
    median = F.element_at("gs", F.floor(F.size("gs") / 2).cast("int") + 1)
    return own.select("doc_id", "base", F.when(F.size("gs") < 5, F.col("base") * 1.8).otherwise(F.greatest(median * 1.3, F.col("base") * 1.5)).alias("threshold"))


def page_margins(lines: DataFrame) -> DataFrame:
    """(doc_id, page, left, right, center, width, concentration, multi_column) of pages with three or more lines of three or
    more items: the commonest start of a line in steps of 5 points (the smaller of equally common ones), the end at nine
    tenths, the share of starts within two steps of the left margin, and whether neighbouring starts that have a fifth of
    the lines each are 120 points or more apart."""
    own = lines.where("items >= 3").select("doc_id", "page", F.round(F.col("x") / 5).cast("int").alias("step"), "x2")
    of = own.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("step")).alias("steps"), F.array_sort(F.collect_list("x2")).alias("ends"), F.count("*").cast("int").alias("n")).where("n >= 3")
    count = "size(filter(steps, s -> s = k))"
    of = of.withColumn("best", F.expr(f"-array_max(transform(array_distinct(steps), k -> struct({count} as c, -k as k))).k"))
    of = of.withColumn("strong", F.expr(f"filter(array_distinct(steps), k -> {count} * 5 >= n)"))
    of = of.select("doc_id", "page", (F.col("best") * 5.0).alias("left"), F.expr("element_at(ends, int(n * 9 div 10 + 1))").alias("right"), F.expr("size(filter(steps, s -> abs(s - best) <= 2)) / n").alias("concentration"), F.expr("exists(sequence(1, size(strong)), i -> i > 1 and strong[i - 1] - strong[i - 2] >= 24)").alias("multi_column"))
    of = of.withColumn("width", F.greatest(F.col("right") - F.col("left"), F.lit(1.0)))
    return of.select("doc_id", "page", "left", "right", (F.col("left") + F.col("width") / 2).alias("center"), "width", "concentration", "multi_column")


#: Words with which a line that goes on may end.
GOES_ON = "the a an and or of in to for with by on at from as is are was were be that this their its our your has have had not".split()


def isolated_lines(lines: DataFrame) -> DataFrame:
    """The lines that stand alone between paragraph gaps, as headings of body size do: one to six words in over three bytes,
    0.95 x the body size or more, no list item or caption, not ending as a line that goes on; none of a page on which over a
    quarter of the lines are such. A line's size is that of its largest item."""
    page = W.partitionBy("doc_id", "page")
    order = page.orderBy("line_no")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    words = F.split(text, " ")
    apart = lambda other: F.coalesce(F.abs(other - F.col("y")) > F.col("threshold"), F.lit(True))
    short = (F.size(words) <= 6) & (F.octet_length(F.trim("text")) > 3) & (F.col("font_size") >= F.col("base") * 0.95) & ~is_list_item(text) & ~is_caption_line(text)
    ended = ~F.substring(text, -1, 1).isin("-", ",", ";") & ~F.lower(F.element_at(words, -1)).isin(GOES_ON)
    marked = lines.join(paragraph_threshold(lines), "doc_id").withColumn("alone", apart(F.lag("y").over(order)) & apart(F.lead("y").over(order)) & short & ended)
    return marked.withColumn("share", F.avg(F.col("alone").cast("int")).over(page)).where("alone and share <= 0.25").select(*lines.columns)


def cluster_rects(rects: list[tuple], tolerance: float, least: int = 1) -> list[list[int]]:
    """Connected components, of the least size or more, of rectangles (x, y, width, height) that overlap when each is
    widened by the tolerance; ordered by their first members. Components of any size are whole: the reference gives up on
    those of 2000."""
    n = len(rects)
    x, y, w, h = np.array(rects, float).reshape(n, 4).T
    left, right, low, top = x - tolerance, x + w + tolerance, y - tolerance, y + h + tolerance
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    order = np.argsort(left, kind="stable")
    starts = left[order]
    for k, i in enumerate(order.tolist()):
        near = order[k + 1 : max(k + 1, int(np.searchsorted(starts, right[i], "right")))]
        for j in near[(low[near] <= top[i]) & (top[near] >= low[i])].tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    return [g for g in groups.values() if len(g) >= least]


def rect_components(rects: DataFrame, tolerance: float, least: int = 1) -> DataFrame:
    """(doc_id, page, idx, component): the component of each rectangle (doc_id, page, idx, x, y, width, height) that is in one
    of the least size or more, numbered from 0 on its page; a page at a time."""
    kind = rects.schema["doc_id"].dataType.simpleString()

    def run(key, t):
        t = t.sort_by("idx")
        found = cluster_rects(list(zip(*(t.column(c).to_pylist() for c in ("x", "y", "width", "height")))), tolerance, least)
        rows = [(i, n) for n, g in enumerate(found) for i in g]
        idx = t.column("idx").take(pa.array([i for i, _ in rows], pa.int64()))
        k = len(rows)
        return pa.table([pa.array([key[0].as_py()] * k, t.schema.field("doc_id").type), pa.array([key[1].as_py()] * k, pa.int32()), idx.cast(pa.int32()), pa.array([n for _, n in rows], pa.int32())], ["doc_id", "page", "idx", "component"])

    return rects.groupBy("doc_id", "page").applyInArrow(run, f"doc_id {kind}, page int, idx int, component int")


def classified(pages: DataFrame) -> DataFrame:
    """Documents by the operations of their pages (doc_id, page, text_ops, images, distinct_chars): classification,
    confidence, page_count, pages_needing_ocr."""
    few = F.when(F.col("images") > 0, 10).otherwise(3)
    text = (F.col("text_ops") >= few) & (F.col("distinct_chars") >= 5) & ~((F.col("images") > 10) & (F.col("images") > 3 * F.col("text_ops")))
    of = pages.withColumn("is_text", text).groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.avg(F.col("is_text").cast("int")).alias("r"),
        F.max("text_ops").alias("ops"),
        F.max("images").alias("images"),
        F.array_sort(F.collect_list(F.when(~F.col("is_text") & (F.col("images") > 0), F.col("page")))).alias("pages_needing_ocr"),
    )
    kind = F.when(F.col("r") >= 0.6, "TextBased").when(F.col("ops") == 0, "Scanned").when(F.col("images") > 0, "Mixed").otherwise("TextBased")
    sure = F.when(F.col("r") >= 0.6, F.col("r")).when(F.col("ops") == 0, F.when(F.col("images") > 0, 0.95).otherwise(0.9)).when(F.col("images") > 0, 0.7).otherwise(F.greatest("r", F.lit(0.5)))
    return of.select("doc_id", kind.alias("classification"), sure.alias("confidence"), "page_count", "pages_needing_ocr")


def kept(values: list[float], apart: float) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > apart:
            out.append(v)
    return out


def table_from_lines(items: list[dict], segments: list[tuple], apart: float = 6.0) -> list[list[str]] | None:
    """A ruled table: the grid of horizontal and vertical segments, items in the first cell that holds their centre."""
    xs = kept([s[0] for s in segments if abs(s[0] - s[2]) <= 1 and abs(s[1] - s[3]) > 5], apart)
    ys = kept([s[1] for s in segments if abs(s[1] - s[3]) <= 1 and abs(s[0] - s[2]) > 5], apart)[::-1]
    if len(xs) < 3 or len(ys) < 3 or len(xs) > 26 or len(ys) > 201:
        return None
    cells = [[[] for _ in xs[1:]] for _ in ys[1:]]
    for it in sorted(items, key=lambda i: (-i["y"], i["x"])):
        cx = it["x"] + it["width"] / 2
        col = next((i for i in range(len(xs) - 1) if xs[i] - 2 <= cx <= xs[i + 1] + 2), None)
        row = next((i for i in range(len(ys) - 1) if ys[i + 1] - 2 <= it["y"] <= ys[i] + 2), None)
        if col is not None and row is not None:
            cells[row][col].append(it["text"].strip())
    out = [[" ".join(c) for c in r] for r in cells]
    full = sum(bool(c) for r in out for c in r)
    return out if full >= 0.15 * len(out) * len(out[0]) else None


def clusters(values: list[float], apart: float) -> list[float]:
    """Means of sorted values, each within the distance of the running mean of its cluster."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - sum(out[-1]) / len(out[-1]) <= apart:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def cleaned(cells: list[list[str]]) -> tuple[list[list[str]], list[str]]:
    """Rows without empty ones, continuations joined to the row before, footnotes apart."""
    out: list[list[str]] = []
    notes = []
    for row in cells:
        full = [c for c in row if c.strip()]
        if not full:
            continue
        if len(full) == 1 and row[0] and re.match(r"\([0-9]{1,2}\)|[0-9]{1,2}\)|[*†‡]", row[0].strip()):
            notes.append(row[0].strip())
        elif out and not row[0].strip() and len(full) < sum(bool(c) for c in out[-1]) and len(full) <= len(row) / 2:
            out[-1] = [f"{a} {b}".strip() for a, b in zip(out[-1], row)]
        else:
            out.append([c.strip() for c in row])
    return out, notes


def structure_cells(tokens: list[str]) -> list[dict]:
    """Rows, columns and spans of the cells that table-structure tokens (`<tr>`, `<td`, ` rowspan="2"`, `>`, `</td>`) name."""
    out: list[dict] = []
    taken: set[tuple[int, int]] = set()
    row, spans = -1, {"rowspan": 1, "colspan": 1}
    for t in tokens:
        if t == "<tr>":
            row += 1
        for k, n in re.findall(r'(rowspan|colspan)="([0-9]+)"', t):
            spans[k] = max(1, int(n))
        if t in ("<td>", "<td></td>", ">"):
            col = 0
            while (row, col) in taken:
                col += 1
            taken.update((row + r, col + c) for r in range(spans["rowspan"]) for c in range(spans["colspan"]))
            out.append({"row": max(row, 0), "col": col, **spans})
            spans = {"rowspan": 1, "colspan": 1}
    return out


def items_in_regions(items: DataFrame, regions: DataFrame, margin: float = 1.5, cell: float = 200.0) -> DataFrame:
    """Items whose boxes overlap regions (doc_id, page, region, x1, y1, x2, y2) of the same page, as an equi-join on cells."""
    box = items.withColumn("bottom", F.col("y")).withColumn("top", F.col("y") + F.col("font_size")).withColumn("right", F.col("x") + F.col("width"))
    wide = box.withColumn("cell", F.explode(F.sequence(F.floor(F.col("bottom") / cell).cast("long"), F.floor(F.col("top") / cell).cast("long"))))
    zone = regions.withColumn("cell", F.explode(F.sequence(F.floor((F.col("y1") - margin) / cell).cast("long"), F.floor((F.col("y2") + margin) / cell).cast("long"))))
    hit = (F.col("x") <= F.col("x2") + margin) & (F.col("right") >= F.col("x1") - margin) & (F.col("bottom") <= F.col("y2") + margin) & (F.col("top") >= F.col("y1") - margin)
    once = F.col("cell") == F.floor(F.greatest(F.col("bottom"), F.col("y1") - margin) / cell)
    return wide.join(zone, ["doc_id", "page", "cell"]).where(hit & once).select("doc_id", "page", "region", *[c for c in items.columns if c not in ("doc_id", "page")])


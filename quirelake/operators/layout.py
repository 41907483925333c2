"""Positions on pages: lines, columns, tiers, regions. Rows stand by key (a document and page) and explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def islands(rows: DataFrame, keys: list[str], order: list, breaks: Column) -> DataFrame:
    """Rows with island: how many breaks stood up to them. breaks may look at lag columns of the same window."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("island", F.sum("__break").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__break")


def mode_of(rows: DataFrame, keys: list[str], value: str, smaller: bool = True) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smaller (or larger). Counts are combined first."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    tie = -F.col(value) if smaller else F.col(value)
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("__n", tie)).alias("mode"), F.max("__n").alias("n"))


def kept_edges(values: Column, tolerance: float) -> Column:
    """Sorted values, each at least the tolerance above the last one that was kept."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda done, v: F.when((F.size(done) == 0) | (v - F.element_at(done, -1) > tolerance), F.array_append(done, v)).otherwise(done))


def tiers(sizes: Column, base: Column, ratio: float = 1.2, apart: float = 0.5, most: int = 4) -> Column:
    """Sizes from ratio x base up, largest first; one of each cluster, the first `most`."""
    large = F.reverse(F.array_sort(F.filter(sizes, lambda s: s >= base * ratio)))
    pick = F.aggregate(large, F.array().cast("array<double>"), lambda done, v: F.when((F.size(done) == 0) | (F.element_at(done, -1) - v > apart), F.array_append(done, v)).otherwise(done))
    return F.slice(pick, 1, most)


def interval_of(value: Column, edges: Column, tolerance: float = 0.0) -> Column:
    """The first interval [edge i, edge i + 1) that holds the value, from 0; null if none does."""
    i = F.array_position(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: (value >= F.get(edges, k - 1) - tolerance) & (value < F.get(edges, k) + tolerance)), True)
    return F.when(F.size(edges) > 1, F.when(i > 0, i - 1)).cast("int")


def nearest(value: Column, centres: Column, within: Column) -> Column:
    """The index of the nearest centre, the first of equally near ones; null if none is within the distance."""
    best = F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(value - c).alias("d"), i.alias("i"))))
    return F.when(best["d"] <= within, best["i"])


def overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Rows whose intervals overlap, as an equi-join: intervals are cut into cells of a width, and a pair is kept in the
    cell where the later of both starts."""
    cells = lambda df, lo, hi, n: df.withColumn(n, F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))))
    x, y = cells(left, *a, "__cell"), cells(right, *b, "__cell")
    joined = x.join(y, [key, "__cell"])
    return joined.where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("__cell") == F.floor(F.greatest(a[0], b[0]) / width))).drop("__cell")


def number_ranges(spec: str, most: int = 100_000) -> list[int]:
    """`1,3-5` to its numbers, ascending and once each. Empty parts, zero and reversed ranges are errors."""
    out: set[int] = set()
    for part in spec.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not lo.strip().isdigit() or (dash and not hi.strip().isdigit()):
            raise ValueError(f"not a number or range: {part!r}")
        a, b = int(lo), int(hi) if dash else int(lo)
        if a < 1 or b < a or b - a >= most or len(out) + b - a + 1 > most:
            raise ValueError(f"bad range: {part!r}")
        out.update(range(a, b + 1))
    return sorted(out)


def sheet_selector(spec: str) -> tuple[list[int], list[str]]:
    """`Sales,2,4-5` to numbers and names."""
    numbers: set[int] = set()
    names = []
    for part in (p.strip() for p in spec.split(",")):
        if part and all(x.strip().isdigit() for x in part.split("-")) and part.count("-") < 2:
            numbers.update(number_ranges(part))
        elif part:
            names.append(part)
    return sorted(numbers), names


def spread_pages(n: int, total: int) -> list[int]:
    """n page numbers spread evenly, the first and the last among them."""
    if n <= 0 or total <= 0:
        return []
    if n >= total:
        return list(range(1, total + 1))
    if n == 1:
        return [1]
    return sorted({1 + i * (total - 1) // (n - 1) for i in range(n)})


def sections(lines: DataFrame, key: str, pattern: str) -> DataFrame:
    """Lines with section: 0 before the first heading that matches, then 1, 2, ..."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.col("line").rlike(pattern).cast("int")).over(w))


def filled_pages(pages: DataFrame, key: str, count: str) -> DataFrame:
    """Pages 1..count of each document; missing ones are empty, of several the first (by ord) stays."""
    one = pages.groupBy(key, "page").agg(F.min_by("text", "ord").alias("text"))
    every = pages.groupBy(key).agg(F.max(count).alias("__n")).select(key, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("page"))
    return every.join(one, [key, "page"], "left").select(key, "page", F.coalesce("text", F.lit("")).alias("text"))

"""Cell tables: (key..., row, col, text) in long form, and what makes grids and markdown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import col_to_name
from ..functions.text import escape_pipes

#: Dense cells of a sheet beyond which only rows and columns with content are kept.
MAX_DENSE_CELLS = 2_000_000


def padded(cells: DataFrame, key: str) -> DataFrame:
    """Every cell of the rectangle that a table's cells span; missing ones are empty. Rows and columns stay absolute.

    The last of several cells at one place wins (column seq, if there is one). Tables over MAX_DENSE_CELLS keep only the
    rows and columns that have a cell."""
    one = cells
    if "seq" in cells.columns:
        one = cells.groupBy(key, "row", "col").agg(F.max_by("text", "seq").alias("text"))
    size = one.groupBy(key).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    size = size.withColumn("dense", (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) <= MAX_DENSE_CELLS)
    rows = size.where("dense").select(key, F.explode(F.sequence("r0", "r1")).alias("row")).unionByName(one.join(size.where("not dense").select(key), key, "left_semi").select(key, "row").distinct())
    cols = size.where("dense").select(key, F.explode(F.sequence("c0", "c1")).alias("col")).unionByName(one.join(size.where("not dense").select(key), key, "left_semi").select(key, "col").distinct())
    grid = rows.join(cols, key)
    return grid.join(one.select(key, "row", "col", "text"), [key, "row", "col"], "left").select(key, "row", "col", F.coalesce("text", F.lit("")).alias("text"))


def trimmed(cells: DataFrame, key: str) -> DataFrame:
    """Without the empty rows and columns at the end; a table without content keeps its first cell."""
    full = F.col("text") != ""
    last = cells.groupBy(key).agg(F.max(F.when(full, F.col("row"))).alias("r1"), F.max(F.when(full, F.col("col"))).alias("c1"), F.min("row").alias("r0"), F.min("col").alias("c0"))
    return cells.join(last, key).where("row <= coalesce(r1, r0) and col <= coalesce(c1, c0)").select(key, "row", "col", "text")


def caption(n: Column, rows: Column, cols: Column) -> Column:
    return F.concat(F.lit("Table "), n.cast("string"), F.lit(" (rows 1–"), rows.cast("string"), F.lit(", cols A–"), col_to_name(cols), F.lit(")"))


def row_texts(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, line): the cells of each row as a line of a pipe table."""
    of_row = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", escape_pipes(F.col("text")).alias("t")))).alias("cs"))
    return of_row.select(key, "row", F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: c["t"]), " | "), F.lit(" |")).alias("line"), F.size("cs").alias("width"))


def table_markdown(cells: DataFrame, key: str, header: bool = True) -> DataFrame:
    """(key, md): the pipe table, the first row (or Col1..ColN) as its header."""
    lines = row_texts(cells, key)
    of = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("ls"), F.max("width").alias("width"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    names = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("Col"), i.cast("string"))), " | "), F.lit(" |"))
    body = F.transform("ls", lambda x: x["line"])
    head, rest = (F.slice(body, 1, 1), F.slice(body, F.lit(2), F.size(body))) if header else (F.array(names), body)
    return of.select(key, F.array_join(F.concat(head, F.array(rule), rest), "\n").alias("md"))


def split_table_row(line: Column) -> Column:
    """The cells of a pipe-table line: cut at pipes that aren't escaped, trimmed, unescaped."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def first_seen_index(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, idx): a dictionary of the distinct values in the order in which they first come, from 0.

    Only the distinct values are numbered: ranges of their first places count theirs, and the counts add up."""
    first = rows.groupBy(value).agg(F.min(order).alias("first"))
    return numbered(first, "first").select(value, F.col("n").alias("idx"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with n, their rank from 0 by a column of distinct values, without one task that sees them all."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    bounds = sorted(set(rows.select(F.col(order).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col(order).cast("double")))
    dealt = rows.withColumn("__part", part)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = counts.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))  # a row for each part
    place = F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn("n", (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")

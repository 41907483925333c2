"""Queries of numbers, cells, grids, markdown tables and the joins between package parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N, text as T
from ..operators import tables as G
from ..session import table


def cell_names(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers to A1 names and back."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 7 % 16384).alias("col"), F.col("p_size").alias("row"))
    ref = N.cell_ref(F.col("row"), F.col("col"))
    return p.select("p_partkey", ref.alias("ref"), N.parse_cell_ref(ref)["col"].cast("long").alias("back"), N.dimension_size(F.concat(F.lit("$B$2:"), ref))["cols"].cast("long").alias("width"))


CELL_NAMES = """
select p_partkey, case when c < 26 then chr(cast(65 + c as int)) when c < 702 then chr(cast(64 + c // 26 as int)) || chr(cast(65 + c % 26 as int))
    else chr(cast(65 + (c - 702) // 676 as int)) || chr(cast(65 + ((c - 26) // 26) % 26 as int)) || chr(cast(65 + c % 26 as int)) end || (p_size + 1) as ref, c back, abs(c - 1) + 1 width
from (select p_partkey, p_partkey * 7 % 16384 c, p_size from part)"""


def excel_serial_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    s, s4 = N.serial_of(F.col("o_orderdate")), N.serial_of(F.col("o_orderdate"), True)
    shifted = s + F.col("o_orderkey") % 86400 / F.lit(86400.0)
    return o.select("o_orderkey", N.excel_serial_text(s).alias("d1900"), N.excel_serial_text(s4, uses_1904=True).alias("d1904"), N.excel_serial_text(shifted, True, True).alias("stamp"))


EXCEL_SERIAL_DATES = """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d1900, strftime(o_orderdate, '%Y-%m-%d') d1904, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') stamp from orders"""


def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and discounts under currency, percent and grouped formats."""
    x = table(spark, sf, "lineitem")
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    return x.select("l_orderkey", "l_linenumber", N.currency(price).alias("money"), N.percent(cut, 0).alias("cut"), N.grouped(-price, 2).alias("minus"), N.grouped(F.lit(-0.001), 2).alias("zero"))


NUMBER_FORMATS = """
select l_orderkey, l_linenumber, '$' || format('{:,.2f}', l_extendedprice) money, format('{:.0f}', l_discount * 100) || '%' cut, '-' || format('{:,.2f}', l_extendedprice) minus, '0.00' zero from lineitem"""


def style_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Cell to style to number format to hint; ids without a code of their own take the built-in one. The dimension
    tables are joined without a hint, so that Spark broadcasts them only while they are small."""
    cells = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).cast("int").alias("style"), F.col("l_extendedprice").alias("v"))
    xfs = spark.range(60).select(F.col("id").cast("int").alias("style"), F.col("id").cast("int").alias("fmt"))
    custom = spark.createDataFrame([(50, '"EUR" #,##0.0;[Red]-0'), (51, "yyyy-mm-dd hh:mm"), (52, "[$-409]$#,##0.00")], "fmt int, code string")
    coded = cells.join(xfs, "style", "left").join(custom, "fmt", "left").withColumn("code", F.coalesce("code", N.builtin_format(F.col("fmt"))))
    hint = N.format_hint(F.col("fmt"), F.col("code"))
    return coded.groupBy(F.coalesce(hint["kind"], F.lit("none")).alias("kind"), hint["decimals"].alias("decimals"), hint["grouping"].alias("grouping")).agg(F.count("*").alias("n"))


STYLE_CHAIN = r"""
with f(fmt, code) as (values (0,'General'),(1,'0'),(2,'0.00'),(3,'#,##0'),(4,'#,##0.00'),(9,'0%'),(10,'0.00%'),(11,'0.00E+00'),(12,'# ?/?'),(13,'# ??/??'),(14,'mm-dd-yy'),(15,'d-mmm-yy'),(16,'d-mmm'),(17,'mmm-yy'),(18,'h:mm AM/PM'),(19,'h:mm:ss AM/PM'),(20,'h:mm'),(21,'h:mm:ss'),(22,'m/d/yy h:mm'),(45,'mm:ss'),(46,'[h]:mm:ss'),(47,'mmss.0'),(49,'@'),(50,'"EUR" #,##0.0;[Red]-0'),(51,'yyyy-mm-dd hh:mm'),(52,'[$-409]$#,##0.00')),
g as (select fmt, code, regexp_replace(split_part(code, ';', 1), '\\.|"[^"]*"?|\[[^\]]*\]', '', 'g') core from f),
h as (select fmt, case when regexp_matches(lower(core), 'yy|dd|mm/|/mm|m/d|d/m|am/pm|h') or fmt between 14 and 22 or fmt between 45 and 47 then 'date' when contains(code, '%') then 'percent' when contains(code, '$') then 'currency' when regexp_matches(code, '[0#]') then 'number' else 'none' end kind,
  length(regexp_extract(core, '^[^.]*\.([0#]*)', 1)) decimals, contains(code, ',') as "grouping" from g)
select coalesce(kind, 'none') kind, coalesce(decimals, 0) decimals, coalesce("grouping", false) as "grouping", count(*) n from lineitem left join h on h.fmt = l_partkey % 60 group by 1, 2, 3"""


def _ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of a region side by side: a ragged table for each region, with some cells left empty."""
    n = table(spark, sf, "nation")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    cells = n.select(F.col("n_regionkey").alias("key"), F.floor(place / 3).cast("int").alias("row"), (place % 3 + 1).cast("int").alias("col"), F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.concat("n_name", F.lit("|x"))).alias("text"))
    more = spark.createDataFrame([(0, 4, 5, "")], "key int, row int, col int, text string")
    return cells.unionByName(more)


_RAGGED = """cells as (select n_regionkey as key, cast((r - 1) // 3 as int) as row, cast((r - 1) % 3 + 1 as int) as col, case when n_nationkey % 7 = 0 then '' else n_name || '|x' end as text
  from (select *, row_number() over (partition by n_regionkey order by n_nationkey) r from nation) union all select 0, 4, 5, ''),
size as (select key, min(row) r0, max(row) r1, min(col) c0, max(col) c1 from cells group by key),
grid as (select s.key, r.row, c.col, coalesce(x.text, '') as text from size s, lateral (select unnest(range(r0, r1 + 1)) as row) r, lateral (select unnest(range(c0, c1 + 1)) as col) c
  left join cells x on x.key = s.key and x.row = r.row and x.col = c.col)"""


def sheet_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.padded(_ragged(spark, sf), "key").select("key", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


SHEET_GRID = f"with {_RAGGED} select key, cast(row as bigint) as row, cast(col as bigint) as col, text from grid"


def sheet_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Without the empty rows and columns at the end, as sizes and captions."""
    cells = G.trimmed(G.padded(_ragged(spark, sf), "key"), "key")
    size = cells.groupBy("key").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count("*").alias("cells"))
    return size.select("key", "rows", "cols", "cells", G.caption(F.col("key") + 1, F.col("rows"), F.col("cols")).alias("caption"))


SHEET_TRIMMED = f"""with {_RAGGED}, l as (select key, max(row) filter (text <> '') r1, max(col) filter (text <> '') c1 from grid group by key),
t as (select g.* from grid g join l using (key) where g.row <= r1 and g.col <= c1)
select key, max(row) + 1 as rows, max(col) + 1 cols, count(*) cells, 'Table ' || (key + 1) || ' (rows 1–' || (max(row) + 1) || ', cols A–' || chr(cast(65 + max(col) as int)) || ')' caption from t group by key"""


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return G.table_markdown(G.padded(_ragged(spark, sf), "key"), "key")


TABLE_MARKDOWN = f"""with {_RAGGED}, l as (select key, row, '| ' || string_agg(replace(text, '|', '\\|'), ' | ' order by col) || ' |' line, count(*) w from grid group by key, row)
select key, string_agg(line || case when row = 0 then chr(10) || '|' || repeat(' --- |', w) else '' end, chr(10) order by row) md from l group by key"""


def table_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of rendered tables, parsed into their cells again."""
    md = G.table_markdown(G.padded(_ragged(spark, sf), "key"), "key", header=False)
    lines = md.select("key", F.posexplode(F.split("md", "\n")).alias("n", "line")).where("n > 1")
    return lines.select("key", F.posexplode(G.split_table_row(F.col("line"))).alias("col", "text"), (F.col("n") - 2).alias("row")).select("key", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


TABLE_ROUND_TRIP = f"with {_RAGGED} select g.key, cast(g.row - r0 as bigint) as row, cast(g.col - c0 as bigint) as col, text from grid g join size using (key)"


def properties_line(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of each customer, sorted, on one line."""
    c = table(spark, sf, "customer")
    kv = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("nation").alias("k"), F.col("c_nationkey").cast("string").alias("v")))).alias("x"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "; ")
    return kv.groupBy("c_custkey").agg(F.concat(F.lit("properties: "), line).alias("line"))


PROPERTIES_LINE = "select c_custkey, 'properties: name=' || c_name || '; nation=' || c_nationkey || '; segment=' || c_mktsegment line from customer"


def shared_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as indices into a dictionary in first-seen order."""
    return G.first_seen_index(table(spark, sf, "part"), "p_brand", "p_partkey")


SHARED_STRINGS = "select p_brand, row_number() over (order by min(p_partkey)) - 1 idx from part group by p_brand"


def shared_strings_read(spark: SparkSession, sf: str) -> DataFrame:
    """Indices to strings; an index that isn't there stays as it is."""
    p = table(spark, sf, "part")
    words = G.first_seen_index(p, "p_brand", "p_partkey")
    cells = p.select("p_partkey", (F.col("p_partkey") % 40).cast("string").alias("raw"))
    return cells.join(words, cells.raw.cast("long") == words.idx, "left").select("p_partkey", F.coalesce("p_brand", "raw").alias("shown"))


SHARED_STRINGS_READ = """with w as (select p_brand, row_number() over (order by min(p_partkey)) - 1 idx from part group by p_brand)
select p_partkey, coalesce(w.p_brand, cast(part.p_partkey % 40 as varchar)) shown from part left join w on idx = p_partkey % 40"""


def rels_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Relationship targets against the folder of their part; external ones stay."""
    from ..operators.packages import normalize_target

    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("word/sub"), F.col("page_id") % 3).alias("base"))
    target = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("../media/./image"), F.col("page_id"), F.lit(".png"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/xl/x"), F.col("page_id"))).when(F.col("page_id") % 4 == 2, F.lit("https://host.example/a/../b")).otherwise(F.lit("../../../deep/./er/../x.xml"))
    return p.select("page_id", normalize_target(F.col("base"), target).alias("resolved"))


RELS_RESOLVED = """select page_id, case page_id % 4 when 0 then 'word/media/image' || page_id || '.png' when 1 then 'xl/x' || page_id when 2 then 'https://host.example/a/../b' else 'deep/x.xml' end resolved from pages"""


def sheet_ref_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas after a sheet is renamed."""
    from ..operators.packages import rewrite_sheet_refs

    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("=Data!A"), F.col("o_custkey"), F.lit("+'Data'!B2+MyData!C3+Data2!D")).alias("f"))
    return o.select("o_orderkey", rewrite_sheet_refs(F.col("f"), "Data", "My Sheet").alias("formula"))


SHEET_REF_REWRITE = "select o_orderkey, '=''My Sheet''!A' || o_custkey || '+''My Sheet''!B2+MyData!C3+Data2!D' formula from orders"


def csv_formula_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that start with = are notes with their address, and stay in the cell."""
    o = table(spark, sf, "orders")
    cell = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("=B"), F.col("o_orderkey"), F.lit("*2"))).otherwise(F.col("o_orderpriority"))
    rows = o.select((F.col("o_orderkey") - 1).alias("row"), cell.alias("text")).where(F.startswith("text", F.lit("=")))
    return rows.select(N.cell_ref(F.col("row"), F.lit(2)).alias("cell_ref"), F.col("text").alias("formula"))


CSV_FORMULA_NOTES = "select 'C' || o_orderkey cell_ref, '=B' || o_orderkey || '*2' formula from orders where o_orderkey % 5 = 0"


def table_data_like(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("NE"), F.col("p_size"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size"), F.lit(" kHz"))).when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise(F.lit("12/04/2020"))
    return table(spark, sf, "part").select("p_partkey", N.looks_like_table_data(c).alias("data"), F.size(N.financial_values(F.concat(F.lit("$ 1,234 (5.5%) "), F.col("p_size")))).cast("long").alias("values"))


TABLE_DATA_LIKE = r"""
select p_partkey, case p_partkey % 4 when 2 then regexp_matches(p_name, '^[0-9.,+-]*[0-9][0-9.,+-]*$') or (length(p_name) <= 10 and regexp_matches(p_name, '^[A-Za-z0-9]+$') and regexp_matches(p_name, '[0-9]')) or (regexp_matches(p_name, '[0-9]') and regexp_matches(p_name, '°|V|A|Hz|µ|pin|\(.*\)')) else true end as data,
  3 as "values" from part"""

QUERIES = {
    "table_data_like": (table_data_like, TABLE_DATA_LIKE),
    "cell_names": (cell_names, CELL_NAMES),
    "excel_serial_dates": (excel_serial_dates, EXCEL_SERIAL_DATES),
    "number_formats": (number_formats, NUMBER_FORMATS),
    "style_chain_join": (style_chain, STYLE_CHAIN),
    "sheet_grid_padded": (sheet_grid, SHEET_GRID),
    "sheet_trim_edges": (sheet_trimmed, SHEET_TRIMMED),
    "table_markdown": (table_markdown, TABLE_MARKDOWN),
    "table_round_trip": (table_round_trip, TABLE_ROUND_TRIP),
    "kv_properties_sorted": (properties_line, PROPERTIES_LINE),
    "shared_strings_dictionary": (shared_strings, SHARED_STRINGS),
    "shared_strings_deref": (shared_strings_read, SHARED_STRINGS_READ),
    "rels_resolve_path": (rels_resolved, RELS_RESOLVED),
    "sheet_ref_rewrite": (sheet_ref_rewrite, SHEET_REF_REWRITE),
    "csv_formula_notes": (csv_formula_notes, CSV_FORMULA_NOTES),
}

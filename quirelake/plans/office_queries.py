"""Queries that make office files with links, comments, notes, tables, formulas and several sheets, and read, select, patch and
convert them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import markdown as M
from ..session import table
from ..sources import documents as S

BARE = M.Options(frontmatter=False)


def _ordered(by: str, line: Column, sep: str = "\n") -> Column:
    """The lines of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), line.alias("l")))), lambda x: x["l"]), sep)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, rows, n): the orders of a customer as lines of a pipe table."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority", F.lit(" |"))
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(_ordered("o_orderkey", line).alias("rows"), F.count("*").alias("n"))


_ORDERS = "select o_custkey doc_id, string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' |', chr(10) order by o_orderkey) as rows, count(*) n from orders group by o_custkey"


def _letters(orders: DataFrame) -> Column:
    """A letter with a link, a comment and a table."""
    return F.concat(
        F.lit("## Section: body\n\nCustomer "), F.col("doc_id").cast("string"), F.lit(" has [these orders](https://host.example/c"), F.col("doc_id").cast("string"), F.lit(") today.[^c0]\n| key | priority |\n| --- | --- |\n"),
        F.col("rows"), F.lit("\n\nThe end\n### Comments\n[^c0|Clerk "), F.col("n").cast("string"), F.lit("]: counted\n\n"),
    )


_LETTER = """'## Section: body' || chr(10) || chr(10) || 'Customer ' || doc_id || ' has [these orders](https://host.example/c' || doc_id || ') today.[^c0]' || chr(10) || '| key | priority |' || chr(10) || '| --- | --- |' || chr(10)
  || rows || chr(10) || chr(10) || 'The end' || chr(10) || '### Comments' || chr(10) || '[^c0|Clerk ' || n || ']: counted'"""


def docx_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Letters with links, comments and tables as word-processing files, read back to the same text."""
    o = _orders(spark, sf)
    docs = S.created(o.select("doc_id", _letters(o).alias("markdown")), "docx")
    return S.markdown(docs.select("doc_id", "content"), BARE).select("doc_id", F.md5(F.trim(F.regexp_replace("markdown", r"\s+$", ""))).alias("digest"))


DOCX_LETTERS = f"with o as ({_ORDERS}) select doc_id, md5({_LETTER}) digest from o"


def docling_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The same letters as nested JSON: texts by label, the size of the table and the first of its cells."""
    o = _orders(spark, sf)
    docs = S.created(o.select("doc_id", _letters(o).alias("markdown")), "docx").select("doc_id", "content")
    j = S.docling_json(docs).select("doc_id", F.from_json("docling", "struct<texts:array<struct<label:string,text:string>>,tables:array<struct<data:struct<num_rows:bigint,num_cols:bigint>>>,groups:array<struct<name:string>>>").alias("d"))
    notes = F.size(F.filter("d.texts", lambda t: t["label"] == "footnote")).cast("long")
    return j.select("doc_id", F.size("d.texts").cast("long").alias("n_texts"), notes.alias("n_notes"), F.col("d.tables")[0]["data"]["num_rows"].alias("n_rows"), F.col("d.tables")[0]["data"]["num_cols"].alias("n_cols"), F.col("d.groups")[0]["name"].alias("first_group"))


DOCLING_LETTERS = f"with o as ({_ORDERS}) select doc_id, 3 n_texts, 1 n_notes, n + 1 n_rows, 2 n_cols, 'comments' first_group from o"


def pptx_decks(spark: SparkSession, sf: str) -> DataFrame:
    """A presentation for each nation: a slide with a table of its suppliers and notes, one with a comment; the second selected."""
    s = table(spark, sf, "supplier")
    rows = s.groupBy(F.col("s_nationkey").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), _ordered("s_suppkey", F.concat(F.lit("| "), F.col("s_suppkey").cast("string"), F.lit(" |"))).alias("rows"))
    text = F.concat(F.lit("## Slide 1 - Suppliers\n\n| key |\n| --- |\n"), "rows", F.lit("\n\n### Notes\nspoken of "), F.col("n").cast("string"), F.lit("\n\n## Slide 2 - Sum\n\nall "), F.col("n").cast("string"), F.lit("\n### Comments\n[^c1|Who]: why\n\n"))
    docs = S.created(rows.select("doc_id", text.alias("markdown")), "pptx").select("doc_id", "content")
    whole = S.markdown(docs, BARE).select("doc_id", F.md5(F.trim(F.regexp_replace("markdown", r"\s+", " "))).alias("digest"))
    second = S.markdown(docs, BARE, slides={2}).select("doc_id", F.trim(F.regexp_replace("markdown", r"\s+", " ")).alias("second"))
    return whole.join(second, "doc_id")


PPTX_DECKS = """
with s as (select cast(s_nationkey as bigint) doc_id, count(*) n, string_agg('| ' || s_suppkey || ' |', ' ' order by s_suppkey) as rows from supplier group by s_nationkey),
t as (select doc_id, '## Slide 1 - Suppliers | key | | --- | ' || rows || ' ### Notes spoken of ' || n as a, '## Slide 2 - Sum all ' || n || ' ### Comments [^c1|Who]: why' as b from s)
select doc_id, md5(a || ' ' || b) digest, b as second from t"""


def _books(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook for each customer: a sheet of its orders, and one with a formula over them."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.floor("o_totalprice").cast("string"), F.lit(" |"))
    g = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(_ordered("o_orderkey", line).alias("rows"), F.count("*").alias("n"))
    last = (F.col("n") + 1).cast("string")
    text = F.concat(F.lit("## Sheet: Orders\n\n| key | price |\n| --- | --- |\n"), "rows", F.lit("\n\n## Sheet: Sum\n\n| what | all |\n| --- | --- |\n| sum |  |\n\nB2=`=SUM(Orders!B2:B"), last, F.lit(")`\n\n"))
    return S.created(g.select("doc_id", text.alias("markdown")), "xlsx").select("doc_id", "content")


def xlsx_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas of workbooks, and how many rows the sheet that they sum has."""
    ir = S.ir_json(_books(spark, sf)).select("doc_id", F.from_json("ir", "struct<sheets:array<struct<name:string,formulas:array<struct<cell_ref:string,formula:string>>,tables:array<struct<rows:array<array<struct<content:array<struct<Paragraph:string>>>>>>>>>>").alias("d"))
    f = F.col("d.sheets")[1]["formulas"][0]
    return ir.select("doc_id", f["cell_ref"].alias("cell_ref"), f["formula"].alias("formula"), F.col("d.sheets")[0]["name"].alias("sheet"))


XLSX_FORMULAS = "select o_custkey doc_id, 'B2' cell_ref, 'SUM(Orders!B2:B' || (count(*) + 1) || ')' formula, 'Orders' sheet from orders group by o_custkey"


def xlsx_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """The sheets of workbooks after one was renamed, and the formula that refers to it."""
    out = S.patched(_books(spark, sf), {"renames": [("Orders", "All orders")]}).select("doc_id", F.col("result.content").alias("content"))
    names = S.sheet_names(out).select("doc_id", F.array_join("names", "|").alias("names"))
    formula = S.markdown(out, BARE, sheets=([2], [])).select("doc_id", F.regexp_extract("markdown", "B2=`([^`]*)`", 1).alias("formula"), (~F.contains("markdown", F.lit("## Sheet: All"))).alias("selected"))
    return names.join(formula, "doc_id")


XLSX_RENAMED = "select o_custkey doc_id, 'All orders|Sum' as names, '=SUM(''All orders''!B2:B' || (count(*) + 1) || ')' formula, true selected from orders group by o_custkey"


def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines the letters of a customer change by when its first order goes: the lines of a unified diff."""
    o = _orders(spark, sf)
    pairs = o.select("doc_id", F.col("rows").alias("a"), F.regexp_replace("rows", r"^[^\n]*\n?", "").alias("b"))
    found = S.diffs(pairs, 0).select("doc_id", F.filter(F.split("diff", "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2} )")).alias("x"))
    return found.select("doc_id", F.size(F.filter("x", lambda x: x.startswith("-"))).cast("long").alias("gone"), F.size(F.filter("x", lambda x: x.startswith("+"))).cast("long").alias("made"))


CHANGED_DOCUMENTS = "select o_custkey doc_id, 1 gone, 0 made from orders group by o_custkey"


def diff_balances(spark: SparkSession, sf: str) -> DataFrame:
    """By how many lines a turn is longer than the one before it, as their unified diff has it, and whether it has any line."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    pairs = c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("a"), F.col("text").alias("b"))
    lines = F.split("diff", "\n")
    # the first two lines of a diff name its sides
    of = lambda sign: F.size(F.filter(F.slice(lines, 3, 1 << 30), lambda x: x.startswith(sign)))
    return S.diffs(pairs, 0).select("doc_id", (of("+") - of("-")).cast("long").alias("longer"), (F.col("diff") == "").alias("same"))


DIFF_BALANCES = """
with t as (select conv_id || '-' || turn doc_id, text b, lag(text) over (partition by conv_id order by turn) a from conversations)
select doc_id, cast(len(string_split(b, chr(10))) - case when a is null then 0 else len(string_split(a, chr(10))) end as bigint) longer, coalesce(a, '') = b same from t"""

QUERIES = {
    "diff_balances": (diff_balances, DIFF_BALANCES),
    "docx_letters": (docx_letters, DOCX_LETTERS),
    "docling_letters": (docling_letters, DOCLING_LETTERS),
    "pptx_decks": (pptx_decks, PPTX_DECKS),
    "xlsx_formulas": (xlsx_formulas, XLSX_FORMULAS),
    "xlsx_renamed": (xlsx_renamed, XLSX_RENAMED),
    "changed_documents": (changed_documents, CHANGED_DOCUMENTS),
}

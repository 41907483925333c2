"""Queries that build office files from the tables, read them back and compare; SQL says what must come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import markdown as M
from ..session import table
from ..sources import documents as S


def _markdown_of_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook text for each region: its nations on a sheet."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))), "\n")
    text = F.concat(F.lit("## Sheet: "), "r_name", F.lit("\n\n| key | name |\n| --- | --- |\n"), body, F.lit("\n\n"))
    return r.join(rows, r.r_regionkey == rows.n_regionkey).select(F.col("r_regionkey").alias("doc_id"), text.alias("markdown"))


def xlsx_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to workbooks, and their cells by joins with the shared strings."""
    books = S.created(_markdown_of_regions(spark, sf), "xlsx").select("doc_id", "content")
    cells = S.xlsx_texts(books, style_aware=False)
    return cells.where("row > 0").select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


XLSX_ROUND_TRIP = """
with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) r from nation)
select n_regionkey doc_id, r as row, 0 as col, cast(n_nationkey as varchar) as text from n union all select n_regionkey, r, 1, n_name from n"""


def docx_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as word-processing files, and their paragraphs read back."""
    c = table(spark, sf, "conversations")
    clean = F.regexp_replace("text", r"[^\p{L}\p{N} .,;!?-]", " ")
    own = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim(clean).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    docs = S.created(own.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("## Section: body\n\n"), "body", F.lit("\n")).alias("markdown")), "docx")
    return S.markdown(docs.select("doc_id", "content"), M.Options(frontmatter=False)).select("doc_id", F.md5("markdown").alias("digest"))


DOCX_ROUND_TRIP = r"""
select conv_id doc_id, md5('## Section: body' || chr(10) || chr(10) || string_agg(trim(regexp_replace(text, '[^\p{L}\p{N} .,;!?-]', ' ', 'g')), chr(10) order by turn) || chr(10)) digest from conversations group by conv_id"""


def patch_report(spark: SparkSession, sf: str) -> DataFrame:
    """Replacements in workbooks, with reports."""
    books = S.created(_markdown_of_regions(spark, sf), "xlsx").select("doc_id", "content")
    out = S.patched(books, {"replaces": [{"find": "A", "to": "[A]", "scope": "shared_strings"}]})
    return out.select("doc_id", F.col("result.parts_modified").alias("modified"), F.col("result.replacements_applied").alias("applied"))


PATCH_REPORT = """select n_regionkey doc_id, 1 modified, sum(length(n_name) - length(replace(n_name, 'A', ''))) applied from nation group by 1"""


def ir_json(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of workbooks as JSON, down to the names of the sheets."""
    books = S.created(_markdown_of_regions(spark, sf), "xlsx").select("doc_id", "content")
    ir = S.ir_json(books, light=True)
    return ir.select("doc_id", F.get_json_object("ir", "$.kind").alias("kind"), F.get_json_object("ir", "$.sheets[0].name").alias("name"))


IR_JSON = "select r_regionkey doc_id, 'Xlsx' kind, r_name as name from region"


def pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    """One-page PDF files of part names, and their texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(1).to_pylist():
                words = name.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                page = b"BT /F1 12 Tf 72 700 Td (" + words + b") Tj ET"
                objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
                out.append(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"%%EOF")
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    files = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name")).mapInArrow(build, "doc_id long, content binary")
    return S.pdf_items(files).select("doc_id", F.col("page").cast("long").alias("page"), "text", "y")


PDF_TEXT = "select p_partkey doc_id, 1 page, p_name as text, 700.0 y from part"


def near_copies_diffed(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines a turn and the one before it differ by, in a unified diff without context."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("a"), F.col("text").alias("b"))
    return S.diffs(pairs, 0).select("doc_id", F.size(F.filter(F.split("diff", "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2} )"))).cast("long").alias("changed"))


def formats_detected(spark: SparkSession, sf: str) -> DataFrame:
    books = S.created(_markdown_of_regions(spark, sf), "xlsx").select("doc_id", "content")
    from ..operators.packages import detected_format

    return detected_format(S.parts(books))


FORMATS_DETECTED = "select r_regionkey doc_id, 'xlsx' format from region"

QUERIES = {
    "xlsx_round_trip": (xlsx_round_trip, XLSX_ROUND_TRIP),
    "docx_round_trip": (docx_round_trip, DOCX_ROUND_TRIP),
    "patch_report": (patch_report, PATCH_REPORT),
    "ir_json": (ir_json, IR_JSON),
    "pdf_text_items": (pdf_text, PDF_TEXT),
    "diff_markdown": (near_copies_diffed, None),
    "format_detection": (formats_detected, FORMATS_DETECTED),
}

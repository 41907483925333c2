"""Queries that set tables of the schema as PDF pages, read them back and say what must come out; and other file round trips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import markdown as M, page_tables as T, pages as P, reading as R
from ..session import table
from ..sources import documents as S


def _escaped(text: str) -> bytes:
    return text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def show(x: float, y: float, text: str, size: float = 10) -> bytes:
    return b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (size, x, y, _escaped(text))


def pdf_file(pages: list[bytes], on_page: list[bytes] | None = None, more: list[bytes] | None = None, root: bytes = b"") -> bytes:
    """A file of content streams in Courier-like widths (half an em for each character). Page k is object 10 + 2k; on_page: what
    stands in its dictionary besides; more: objects from 5000 on; root: what stands in the catalog."""
    own = on_page or [b""] * len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % root, 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [%s] >>" % (b"500 " * 224)}
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))), len(pages))
    for k, (body, extra) in enumerate(zip(pages, own, strict=True)):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> %s >>" % (11 + 2 * k, extra)
        objects[11 + 2 * k] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
    objects |= {5000 + k: o for k, o in enumerate(more or [])}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"%%EOF"


def files_of(rows: DataFrame, make: Callable) -> DataFrame:
    """(doc_id, content) from (doc_id, data): the file that make(data) gives."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            yield pa.record_batch([b.column(0), pa.array([make(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    # making and reading files takes long for few bytes: a row group's rows are dealt out
    return rows.select("doc_id", "data").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(build, f"doc_id {id_type}, content binary")


PAGE_ROWS, ROW_HIGH, COLS = 30, 20, (60.0, 180.0, 300.0, 460.0)


def _table_pages(rows: list[list[str]], drawn: Callable) -> bytes:
    pages = []
    for lo in range(0, max(1, len(rows) - 1), PAGE_ROWS):
        own = [rows[0], *rows[1 + lo : 1 + lo + PAGE_ROWS]]
        text = b"".join(show(COLS[c] + 4, 714 - ROW_HIGH * r, v) for r, row in enumerate(own) for c, v in enumerate(row))
        pages.append(drawn(len(own)) + text)
    return pdf_file(pages)


def _rules(n: int) -> bytes:
    low = 730 - ROW_HIGH * n
    across = b"".join(b"%g %g m %g %g l S\n" % (COLS[0], 730 - ROW_HIGH * r, COLS[-1], 730 - ROW_HIGH * r) for r in range(n + 1))
    return across + b"".join(b"%g %g m %g 730 l S\n" % (x, low, x) for x in COLS)


def _cells(n: int) -> bytes:
    return b"".join(b"%g %g %g %d re S\n" % (a, 730 - ROW_HIGH * (r + 1), b - a, ROW_HIGH) for r in range(n) for a, b in zip(COLS, COLS[1:]))


def _text_of(found: DataFrame) -> DataFrame:
    """The markdown of documents without front matter and page headings, its white space as one space."""
    return found.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("markdown", r"(?m)^## Page: [0-9]+$", ""), r"\s+", " ")).alias("text"))


BARE = M.Options(frontmatter=False)


def pdf_ruled_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of each customer as a ruled table over as many pages as it takes, read back as one."""
    o = table(spark, sf, "orders")
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))
    rows = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    data = rows.select("doc_id", F.concat(F.array(F.array(*map(F.lit, ("order", "status", "priority")))), F.transform("rows", lambda r: r["cells"])).alias("data"))
    return _text_of(S.markdown(files_of(data, lambda d: _table_pages(d, _rules)), BARE)).select("doc_id", F.md5("text").alias("digest"))


PDF_RULED_TABLES = """
select o_custkey doc_id, md5('|order|status|priority| |---|---|---| ' || string_agg('|' || o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|', ' ' order by o_orderkey)) digest
from orders group by o_custkey"""


def pdf_rect_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of each nation and segment as a table whose cells are rectangles, with a row of their number."""
    c = table(spark, sf, "customer")
    row = F.struct("c_custkey", F.array(F.col("c_custkey").cast("string"), F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.concat(F.lit("v"), F.round(F.col("c_acctbal")).cast("long").cast("string"))).alias("cells"))
    rows = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    last = F.array(F.array(F.lit("all"), F.concat(F.lit("n"), F.size("rows").cast("string")), F.lit("end")))
    data = rows.select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("doc_id"), F.concat(F.array(F.array(*map(F.lit, ("key", "name", "value")))), F.transform("rows", lambda r: r["cells"]), last).alias("data"))
    return _text_of(S.markdown(files_of(data, lambda d: _table_pages(d, _cells)), BARE)).select("doc_id", F.md5("text").alias("digest"))


PDF_RECT_TABLES = """
with c as (select c_nationkey || '-' || c_mktsegment doc_id, c_custkey, '|' || c_custkey || '|' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') || '|v' || cast(round(c_acctbal) as bigint) || '|' as line from customer)
select doc_id, md5('|key|name|value| |---|---|---| ' || string_agg(line, ' ' order by c_custkey) || ' |all|n' || count(*) || '|end|') digest from c group by doc_id"""

LINE_WORDS, COLUMN_LINES = 5, 45


def _two_columns(lines: list[str]) -> bytes:
    pages = []
    for lo in range(0, len(lines), 2 * COLUMN_LINES):
        own = lines[lo : lo + 2 * COLUMN_LINES]
        half = (len(own) + 1) // 2
        pages.append(b"".join(show(30 if k < half else 330, 700 - 13 * (k % half), t, 8) for k, t in enumerate(own)))
    return pdf_file(pages or [b""])


def _lines_of(text: Column) -> Column:
    """Lines of five lower-case words, cut to 11 letters each, after the line's number in letters; all filled to one width."""
    words = F.transform(F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), lambda w: F.length(w) > 1), lambda w: F.substring(w, 1, 11))

    def lines(ws: Column) -> Column:
        count = F.ceil(F.size(ws) / LINE_WORDS).cast("int")
        said = lambda k: F.array_join(F.slice(ws, k * LINE_WORDS + 1, F.lit(LINE_WORDS)), " ")
        line = lambda k: F.rpad(F.concat(F.translate((k + 10000).cast("string"), "0123456789", "abcdefghij"), F.lit("x "), said(k)), 66, "z")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), line)).otherwise(F.array().cast("array<string>"))

    # the words are a variable, so that they are made once for a text rather than once for each of its lines
    return F.transform(F.array(words), lines)[0]


def pdf_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Documents set in two columns, read back: column by column where both have 15 lines or more, else line by line."""
    data = table(spark, sf, "documents").select("doc_id", _lines_of(F.coalesce("text", F.lit(""))).alias("data"))
    return _text_of(S.markdown(files_of(data, _two_columns), BARE)).select("doc_id", F.md5("text").alias("digest"))


PDF_COLUMNS = r"""
with w as (select doc_id, list_transform(list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: length(x) > 1), lambda x: x[1:11]) ws from documents),
l as (select doc_id, ws, unnest(range(0, cast(ceil(len(ws) / 5.0) as bigint))) k from w),
t as (select doc_id, k, k // 90 page, rpad(translate(cast(k + 10000 as varchar), '0123456789', 'abcdefghij') || 'x ' || array_to_string(ws[k * 5 + 1:k * 5 + 5], ' '), 66, 'z') line from l),
h as (select *, (count(*) over (partition by doc_id, page) + 1) // 2 half, count(*) over (partition by doc_id, page) // 2 rest from t),
o as (select doc_id, line, page, case when rest >= 15 then k else (k - page * 90) % half * 2 + (k - page * 90) // half end place from h),
d as (select doc_id, md5(string_agg(line, ' ' order by page, place)) digest from o group by doc_id)
select documents.doc_id, coalesce(digest, md5('')) digest from documents left join d using (doc_id)"""


def pdf_links(spark: SparkSession, sf: str) -> DataFrame:
    """Web addresses as link annotations, read back with their places."""

    def make(url: str) -> bytes:
        link = b"<< /Type /Annot /Subtype /Link /Rect [72 690 272 702] /A << /S /URI /URI (%s) >> >>" % _escaped(url)
        return pdf_file([show(72, 692, "a link")], [b"/Annots [5000 0 R 5001 0 R]"], [link, b"<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /Dest (inner) >>"])

    data = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("data"))
    return S.pdf_links(files_of(data, make)).select("doc_id", F.col("page").cast("long").alias("page"), "url", "x", "width")


PDF_LINKS = "select page_id doc_id, 1 page, url, 72.0 x, 200.0 width from pages"


def pdf_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as filled forms: a text field and a choice, read back with their names."""

    def make(data: list[str]) -> bytes:
        fields = [b"<< /T (customer) /Kids [5001 0 R 5002 0 R] >>", b"<< /T (name) /FT /Tx /V (%s) /Rect [72 600 272 612] /P 10 0 R /Parent 5000 0 R >>" % _escaped(data[0]), b"<< /T (segment) /FT /Ch /V (%s) /Rect [72 560 272 572] /P 10 0 R /Parent 5000 0 R >>" % _escaped(data[1])]
        return pdf_file([show(72, 692, "a form of a few words that is long enough to be read as text")], None, fields, b"/AcroForm << /Fields [5000 0 R] >>")

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.array("c_name", "c_mktsegment").alias("data"))
    return S.pdf_fields(files_of(c, make)).select("doc_id", F.col("page").cast("long").alias("page"), "name", "text", "y")


PDF_FIELDS = "select c_custkey doc_id, 1 page, 'customer.name' as name, c_name as text, 600.0 y from customer union all select c_custkey, 1, 'customer.segment', c_mktsegment, 560.0 from customer"


def _tagged(data: list[str]) -> bytes:
    """A heading under a name of the document's own, a paragraph, and a table, by tags alone: all of one size."""
    marks = [("Title1", data[0], 72, 700), ("P", "segment of this one " + data[1], 72, 680), ("TH", "key", 72, 640), ("TH", "value", 300, 640), ("TD", data[2], 72, 620), ("TD", data[3], 300, 620)]
    page = b"".join(b"/%s << /MCID %d >> BDC\n%sEMC\n" % (tag.encode(), k, show(x, y, t)) for k, (tag, t, x, y) in enumerate(marks))
    tree = [b"<< /Type /StructTreeRoot /RoleMap << /Title1 /H2 >> /K [5001 0 R 5002 0 R 5003 0 R] >>"]
    tree += [b"<< /S /%s /P 5000 0 R /Pg 10 0 R /K %d >>" % (tag.encode(), k) for k, (tag, *_) in enumerate(marks[:2])]
    tree.append(b"<< /S /Table /P 5000 0 R /K [5004 0 R 5005 0 R] >>")
    tree += [b"<< /S /TR /P 5003 0 R /K [%d 0 R %d 0 R] >>" % (5006 + 2 * r, 5007 + 2 * r) for r in range(2)]
    tree += [b"<< /S /%s /Pg 10 0 R /K %d >>" % (tag.encode(), k) for k, (tag, *_) in enumerate(marks) if k >= 2]
    return pdf_file([page], None, tree, b"/StructTreeRoot 5000 0 R")


def pdf_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tagged pages: the heading is one by its tag, mapped to a standard one; the table by its rows and cells."""
    c = table(spark, sf, "customer")
    data = c.select(F.col("c_custkey").alias("doc_id"), F.array(F.regexp_replace("c_name", "[^A-Za-z0-9]", " "), "c_mktsegment", F.concat(F.lit("k"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("data"))
    return _text_of(S.markdown(files_of(data, _tagged), BARE))


PDF_TAGGED = "select c_custkey doc_id, '## ' || regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g') || ' segment of this one ' || c_mktsegment || ' |key|value| |---|---| |k' || c_custkey || '|n' || c_nationkey || '|' as text from customer"


def pdf_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as pages; of each its own text, and whether it must be read from its image: where it shows nothing."""
    clean = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")), "(^| )(.)(?= |$)", " "))
    own = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace(F.substring(clean, 1, 60), " +", " ").alias("t")))).alias("x"))
    data = own.select("doc_id", F.transform("x", lambda x: x["t"]).alias("data"))
    files = files_of(data, lambda d: pdf_file([b"".join(show(72, 600 - 40 * k, w, 9) for k, w in enumerate(["qq " + t, "qq " + t[:20] + " zz"])) if t else b"" for t in d]))
    return S.pdf_pages(files).select("doc_id", F.col("page").cast("long").alias("page"), "needs_ocr", (F.length(F.trim("markdown")) > 0).alias("shown"))


PDF_PAGES = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn) page, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), '(^| )[a-z]( |$)', ' ', 'g')) <> '' has from conversations)
select conv_id doc_id, page, not has needs_ocr, has shown from t"""


def pages_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Users as documents whose events are pages: what they are, how sure that is, and which pages need to be read from images."""
    e = table(spark, sf, "events")
    n = F.floor(F.col("value")).cast("int")
    pages = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), F.pmod(n, F.lit(40)).alias("text_ops"), F.pmod(F.col("event_id"), F.lit(3)).cast("int").alias("images"), F.pmod(n, F.lit(11)).alias("distinct_chars"))
    found = P.classified(pages)
    return found.select("doc_id", "classification", F.round("confidence", 6).alias("confidence"), "page_count", F.size("pages_needing_ocr").cast("long").alias("n_ocr"))


PAGES_CLASSIFIED = """
with p as (select user_id, cast(floor(value) as int) n, cast(event_id % 3 as int) images from events),
q as (select user_id, (n % 40 + 40) % 40 ops, images, (n % 11 + 11) % 11 signs from p),
t as (select *, ops >= case when images > 0 then 10 else 3 end and signs >= 5 and not (images > 10 and images > 3 * ops) is_text from q),
g as (select user_id, count(*) page_count, avg(cast(is_text as int)) r, max(ops) ops, max(images) images, count(*) filter (not is_text and images > 0) n_ocr from t group by user_id)
select user_id doc_id, case when r >= 0.6 then 'TextBased' when ops = 0 then 'Scanned' when images > 0 then 'Mixed' else 'TextBased' end classification,
  round(case when r >= 0.6 then r when ops = 0 then case when images > 0 then 0.95 else 0.9 end when images > 0 then 0.7 else greatest(r, 0.5) end, 6) confidence, page_count, n_ocr from g"""


def running_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Users as documents, days as pages: lines at the edges that repeat, without the pages after the first that has them."""
    e = table(spark, sf, "events")
    w = F.to_date("ts")
    of = e.groupBy("user_id", w.alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    lines = of.select(F.col("user_id").alias("doc_id"), F.datediff("day", F.lit("2000-01-01")).alias("page"), F.posexplode("x").alias("line_no", "e"))
    lines = lines.select("doc_id", "page", "line_no", F.concat("e.event_type", F.lit(" of this user")).alias("text"), F.lit(0.0).alias("x"), (700.0 - F.col("line_no")).alias("y"), F.lit(9.0).alias("x2"), F.lit(10.0).alias("font_size"), F.lit(1).alias("items"))
    return P.without_repeated_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("places"))


RUNNING_HEADERS = """
with l as (select user_id doc_id, date_diff('day', date '2000-01-01', cast(ts as date)) page, row_number() over (partition by user_id, cast(ts as date) order by event_id) - 1 line_no, event_type || ' of this user' as text from events),
m as (select *, 700.0 - line_no y, max(line_no) over (partition by doc_id, page) last from l),
k as (select *, line_no < 3 or line_no > last - 3 edge from m),
s as (select doc_id, text, count(distinct page) n, stddev_pop(y) spread, min(page) first from k where edge group by doc_id, text),
p as (select doc_id, count(distinct page) pages from l group by doc_id),
r as (select s.* from s join p using (doc_id) where n >= greatest(3, ceil(pages * 0.3)) and spread <= 5)
select doc_id, count(*) n, cast(sum(line_no) as bigint) places from k left join r using (doc_id, text) where first is null or not edge or page = first group by doc_id"""


def pptx_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as presentations, a slide for each turn, read back with their titles and texts."""
    c = table(spark, sf, "conversations")
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} ,;!?]", " "), r"\s+", " "))
    turn = F.struct("turn", F.concat(F.lit("## Slide "), F.row_number().over(_turns()).cast("string"), F.lit(" - "), "role", F.lit("\n\nsays "), clean, F.lit("\n")).alias("t"))
    own = c.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("markdown"))
    docs = S.created(own.select(F.col("conv_id").alias("doc_id"), "markdown"), "pptx")
    return S.markdown(docs.select("doc_id", "content"), BARE).select("doc_id", F.md5(F.trim(F.regexp_replace("markdown", r"\s+", " "))).alias("digest"))


def _turns():
    from pyspark.sql import Window as W

    return W.partitionBy("conv_id").orderBy("turn")


PPTX_ROUND_TRIP = r"""
with t as (select conv_id, turn, '## Slide ' || row_number() over (partition by conv_id order by turn) || ' - ' || role || ' says ' || trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N} ,;!?]', ' ', 'g'), '\s+', ' ', 'g')) as line from conversations)
select conv_id doc_id, md5(string_agg(trim(line), ' ' order by turn)) digest from t group by conv_id"""


def docx_patched(spark: SparkSession, sf: str) -> DataFrame:
    """Replacements in word-processing files, whatever runs they stand in, with how many there were."""
    c = table(spark, sf, "conversations")
    clean = F.regexp_replace(F.lower("text"), r"[^a-z ]", " ")
    own = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("the "), clean).alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    docs = S.created(own.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("## Section: body\n\n"), "body", F.lit("\n")).alias("markdown")), "docx")
    out = S.patched(docs.select("doc_id", "content"), {"replaces": [{"find": "the", "to": "THE", "scope": "body", "keep_formatting": True}]})
    return out.select("doc_id", F.col("result.replacements_applied").alias("applied"), "error")


DOCX_PATCHED = r"""
with t as (select conv_id, 'the ' || regexp_replace(lower(text), '[^a-z ]', ' ', 'g') as x from conversations)
select conv_id doc_id, cast(sum((length(x) - length(replace(x, 'the', ''))) // 3) as bigint) applied, cast(null as varchar) as error from t group by conv_id"""


def csv_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as CSV files, with quotes and commas, read back as tables: their size and their cells."""
    c = table(spark, sf, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'))
    own = c.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    files = own.select("doc_id", F.encode(F.concat(F.lit("key,name\n"), "body", F.lit("\n")), "UTF-8").alias("content"), F.lit("csv").alias("format"))
    ir = S.ir_json(files).select("doc_id", F.from_json(F.get_json_object("ir", "$.sheets[0].tables[0].rows"), "array<array<string>>").alias("rows"))
    text = S.markdown(files, BARE).select("doc_id", F.size(F.filter(F.split("markdown", "\n"), lambda x: x.startswith("| "))).cast("long").alias("lines"))
    return text.join(ir, "doc_id").select("doc_id", "lines", F.size("rows").cast("long").alias("n"))


CSV_SHEETS = "select cast(c_nationkey as bigint) doc_id, count(*) + 2 as lines, count(*) + 1 n from customer group by c_nationkey"


def inspected_books(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as workbooks: names and sizes of their sheets without reading the cells."""
    o = table(spark, sf, "orders")
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" |"))
    own = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    books = S.created(own.select("doc_id", F.concat(F.lit("## Sheet: Orders\n\n| key | status |\n| --- | --- |\n"), "body", F.lit("\n\n")).alias("markdown")), "xlsx")
    info = S.inspected(books.select("doc_id", "content")).select("doc_id", F.from_json("info", "struct<sheets:array<struct<name:string,rows:bigint,cols:bigint>>>").alias("i"))
    return info.select("doc_id", F.col("i.sheets")[0]["name"].alias("name"), F.col("i.sheets")[0]["rows"].alias("n_rows"), F.col("i.sheets")[0]["cols"].alias("n_cols"))


INSPECTED_BOOKS = "select o_custkey doc_id, 'Orders' as name, count(*) + 1 n_rows, 2 n_cols from orders group by o_custkey"


def table_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What tells a table from other text, of the orders of each customer: even columns, content, labels, running text."""
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.floor("o_totalprice").cast("long").cast("string"))
    row = F.struct("o_orderkey", F.array(F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit(":"))).otherwise(F.col("o_orderpriority")), price).alias("cells"))
    cells = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("x")).select("doc_id", F.transform("x", lambda x: x["cells"]).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grids = b.column(1).to_pylist()
            made = [[f(g) for g in grids] for f in (T.consistent_columns, lambda g: T.table_content(g, True), T.is_key_value, T.is_paragraph)]
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.bool_()) for x in made)], ["doc_id", "even", "content", "labels", "prose"])

    return cells.mapInArrow(run, "doc_id long, even boolean, content boolean, labels boolean, prose boolean")


TABLE_CHECKS = """
with r as (select o_custkey doc_id, row_number() over (partition by o_custkey order by o_orderkey) k, count(*) over (partition by o_custkey) n,
  case when o_orderkey % 2 = 0 then o_orderpriority || ':' else o_orderpriority end a, case when o_orderkey % 3 = 0 then '' else cast(cast(floor(o_totalprice) as bigint) as varchar) end b from orders),
c as (select doc_id, k, n, a as v, a like '%:' as lab, (b = '') as one from r union all select doc_id, k, n, b, null, null from r),
g as (select doc_id, max(n) n, sum(case when k > 1 and v <> '' then 1 else 0 end) own, sum(case when k > 1 and v <> '' and (regexp_full_match(v, '[0-9]+') or (regexp_matches(v, '[0-9]') and (contains(v, 'V') or contains(v, 'A')))) then 1 else 0 end) data,
  sum(case when k > 1 and v <> '' then length(v) else 0 end) size, sum(cast(lab as int)) labels, sum(case when v <> '' then 1 else 0 end) filled from c group by doc_id)
select doc_id, true even, case when own = 0 then false else data > 0.3 * own or size // own <= 25 end content, labels > 0.5 * n labels,
  filled >= 4 and n > 10 and 1 - filled / (2.0 * n) > 0.55 prose from g"""


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Part names cut in pieces of three characters that touch, as items of a page: put together again as one line."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.regexp_replace("p_name", "[^A-Za-z]", "").alias("t"))
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("t") / 3).cast("int") - 1), lambda k: F.struct(k.alias("idx"), F.substring(F.col("t"), k * 3 + 1, F.lit(3)).alias("text"))))
    items = p.where("length(t) > 0").select("doc_id", piece.alias("e")).select("doc_id", F.lit(1).alias("page"), "e.idx", "e.text", (72.0 + F.col("e.idx") * 15).alias("x"), F.lit(500.0).alias("y"), (F.length("e.text") * 5.0).alias("width"), F.lit("F").alias("font"), F.lit(10.0).alias("font_size"))
    return R.reading_lines(items).select("doc_id", "text", F.col("x2").alias("x2"))


READING_ORDER = "with p as (select p_partkey doc_id, regexp_replace(p_name, '[^A-Za-z]', '', 'g') t from part) select doc_id, t as text, 72.0 + 5.0 * length(t) x2 from p where t <> ''"

QUERIES = {
    "pdf_ruled_tables": (pdf_ruled_tables, PDF_RULED_TABLES),
    "pdf_rect_tables": (pdf_rect_tables, PDF_RECT_TABLES),
    "pdf_columns": (pdf_columns, PDF_COLUMNS),
    "pdf_links": (pdf_links, PDF_LINKS),
    "pdf_fields": (pdf_fields, PDF_FIELDS),
    "pdf_tagged": (pdf_tagged, PDF_TAGGED),
    "pdf_pages": (pdf_pages, PDF_PAGES),
    "pages_classified": (pages_classified, PAGES_CLASSIFIED),
    "running_headers": (running_headers, RUNNING_HEADERS),
    "pptx_round_trip": (pptx_round_trip, PPTX_ROUND_TRIP),
    "docx_patched": (docx_patched, DOCX_PATCHED),
    "csv_sheets": (csv_sheets, CSV_SHEETS),
    "inspected_books": (inspected_books, INSPECTED_BOOKS),
    "table_checks": (table_checks, TABLE_CHECKS),
    "reading_order": (reading_order, READING_ORDER),
}

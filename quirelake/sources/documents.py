"""Office documents as DataFrames. Input: (doc_id, content) or (doc_id, content, format); each row is read by itself, so
readers run where the bytes are and nothing is shuffled. A document that can't be read gives a row with its error instead."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N
from ..operators import docling as D, markdown as M, patches as P
from . import pdf, prose, spreadsheets as X, writers
from .package import Package, resolve_format


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, content, format) of the files under a path; doc_id is the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


def extract(content: bytes, fmt: str | None = None, light: bool = False, style_aware: bool = False, properties: bool = True, sheets=None, slides=None, trim: bool = False, delimiter: str = ",", force: bool = False) -> dict:
    """The document tree. light: spreadsheets as names of sheets only."""
    fmt = resolve_format(content, fmt)
    if fmt == "csv":
        return X.light_csv(content) if light else X.read_csv(content, delimiter, properties, trim)
    if fmt == "xlsx":
        return X.light_xlsx(content) if light else X.read_xlsx(content, style_aware, properties, sheets, trim)
    if fmt == "docx":
        return prose.read_docx(content, properties)
    return prose.read_pptx(content, properties, slides) if fmt == "pptx" else pdf.read_pdf(content, force)


def to_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, sort_keys=True)


def to_markdown(content: bytes, fmt: str | None = None, options: M.Options = M.Options(), **how) -> str:
    """compact texts are trimmed, as their readers are."""
    trim = how.pop("trim", options.profile == "compact")
    return M.render(extract(content, fmt, properties=options.properties, trim=trim, **how), options)


def inspect(content: bytes, fmt: str | None = None) -> dict:
    """What there is in a document."""
    fmt = resolve_format(content, fmt)
    out: dict = {"format": fmt}
    if fmt == "xlsx":
        out["sheets"] = [{"name": n, "rows": r, "cols": c} for n, r, c in X.sheet_sizes(content)]
    elif fmt == "csv":
        t = X.read_csv(content)["sheets"][0]["tables"][0]
        out["sheets"] = [{"name": "Sheet1", "rows": len(t["rows"]), "cols": len(t["headers"])}]
    elif fmt == "docx":
        out["sections"] = [{"name": s["name"], "blocks": len(s["blocks"]), "comment_count": len(s["comments"])} for s in prose.read_docx(content, False)["sections"]]
    elif fmt == "pptx":
        out["slides"] = [{"number": s["number"], "title": s["title"], "has_notes": bool(s["notes"]), "comment_count": len(s["comments"])} for s in prose.read_pptx(content, False)["slides"]]
    else:
        out["pdf"] = pdf.read_pdf(content)["pdf"]["diagnostics"]
    return out


#: Bytes of results that are sent together.
SEND = 8 << 20


def _each(docs: DataFrame, name: str, kind: str, arrow: pa.DataType, make: Callable) -> DataFrame:
    """(doc_id, name, error): what make(row) gives for each document."""
    has = "format" in docs.columns
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, errors, first, held = [], [], 0, 0
            for i in range(b.num_rows):
                value = error = None
                content, fmt = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                try:
                    if content is None:
                        raise ValueError("no content")
                    value = make(content, fmt or None)
                except Exception as e:  # one document that can't be read doesn't stop the others
                    error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
                held += len(content or b"")
                if held >= SEND or i + 1 == b.num_rows:
                    yield pa.record_batch([b.column(0).slice(first, i + 1 - first), pa.array(values, arrow), pa.array(errors, pa.string())], ["doc_id", name, "error"])
                    values, errors, first, held = [], [], i + 1, 0

    own = docs.select("doc_id", "content", F.col("format") if has else F.lit(None).cast("string").alias("format"))
    return own.mapInArrow(run, f"doc_id {id_type}, {name} {kind}, error string")


def markdown(docs: DataFrame, options: M.Options = M.Options(), **how) -> DataFrame:
    return _each(docs, "markdown", "string", pa.string(), lambda c, f: to_markdown(c, f, options, **dict(how)))


def ir_json(docs: DataFrame, **how) -> DataFrame:
    return _each(docs, "ir", "string", pa.string(), lambda c, f: to_json(extract(c, f, **how)))


def docling_json(docs: DataFrame, light: bool = True) -> DataFrame:
    return _each(docs, "docling", "string", pa.string(), lambda c, f: to_json(D.convert(extract(c, f, light=light))))


def inspected(docs: DataFrame) -> DataFrame:
    return _each(docs, "info", "string", pa.string(), lambda c, f: to_json(inspect(c, f)))


def sheet_names(docs: DataFrame) -> DataFrame:
    return _each(docs, "names", "array<string>", pa.list_(pa.string()), lambda c, f: X.sheet_names(c) if resolve_format(c, f) == "xlsx" else ["Sheet1"])


def pdf_fonts(docs: DataFrame) -> DataFrame:
    return _each(docs, "fonts", "string", pa.string(), lambda c, _: to_json(pdf.fonts_used(c)))


def patched(docs: DataFrame, spec: dict) -> DataFrame:
    """(doc_id, result, error): result is struct(content, parts_scanned, parts_modified, replacements_applied)."""
    fields = [("content", pa.binary()), ("parts_scanned", pa.int64()), ("parts_modified", pa.int64()), ("replacements_applied", pa.int64())]

    def make(content: bytes, fmt: str | None) -> dict:
        out, report = P.patch(content, resolve_format(content, fmt), spec)
        return {"content": out} | report

    return _each(docs, "result", "struct<content:binary,parts_scanned:bigint,parts_modified:bigint,replacements_applied:bigint>", pa.struct(fields), make)


def created(texts: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content, error) from (doc_id, markdown)."""
    docs = texts.select("doc_id", F.encode("markdown", "UTF-8").alias("content"))
    return _each(docs, "content", "binary", pa.binary(), lambda c, _: writers.create(M.parse(c.decode())[0], fmt))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, part_name, content_type, bytes): the parts of packages."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                try:
                    package = Package(b.column(1)[i].as_py())
                except Exception:  # no package: it has no parts
                    continue
                by_ext, by_part = package.content_types()
                names = package.parts()
                types = [by_part.get(n, by_ext.get(n.rpartition(".")[2].lower())) for n in names]
                yield pa.record_batch([b.column(0).take(pa.array([i] * len(names), pa.int64())), pa.array(names, pa.string()), pa.array(types, pa.string()), pa.array([package.bytes(n) for n in names], pa.binary())], ["doc_id", "part_name", "content_type", "bytes"])

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {id_type}, part_name string, content_type string, bytes binary")


def _rows(docs: DataFrame, schema: str, make: Callable) -> DataFrame:
    """The rows that make(content) gives for each document; a document that is null or can't be read has none."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = [types[f.strip().split(" ")[1]] for f in schema.split(",")]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, own, held = [], [], 0
            for i in range(b.num_rows):
                content = b.column(1)[i].as_py()
                try:
                    found = list(make(content)) if content is not None else []
                except Exception:  # one document that can't be read doesn't stop the others; `markdown` tells its error
                    found = []
                rows += found
                own += [i] * len(found)
                held += len(content or b"")
                if rows and (held >= SEND or i + 1 == b.num_rows):
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([b.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, arrow, strict=True))], ["doc_id", *names])
                    rows, own, held = [], [], 0

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {id_type}, {schema}")


def xlsx_cells(docs: DataFrame) -> DataFrame:
    """Raw cells of workbooks: sheet (from 1), row and col (from 0), kind, style, raw, inline, formula, seq."""

    def make(content: bytes):
        package = Package(content)
        for n, (_, part) in enumerate(X.sheet_parts(package), 1):
            for seq, c in enumerate(X.sheet_cells(package.required(part))):
                yield n, c["row"], c["col"], c["kind"], c["style"], c["raw"], c["inline"], c["formula"], seq

    return _rows(docs, "sheet int, row int, col int, kind string, style int, raw string, inline string, formula string, seq int", make)


def xlsx_strings(docs: DataFrame) -> DataFrame:
    return _rows(docs, "idx int, value string", lambda c: enumerate(X.Styles(Package(c)).strings))


def _cell_formats(package: Package) -> list[tuple[int, str | None]]:
    """Of each cell style the number format and its code."""
    root = package.xml("xl/styles.xml")
    codes = {} if root is None else {int(e.get("numFmtId", "0")): e.get("formatCode", "") for e in root.iter() if e.tag.endswith("}numFmt")}
    used = [int(xf.get("numFmtId", "0")) for group in (root if root is not None else ()) if group.tag.endswith("}cellXfs") for xf in group]
    return [(fmt, codes.get(fmt)) for fmt in used]


def xlsx_formats(docs: DataFrame) -> DataFrame:
    """The number format of each cell style: style, fmt, code."""
    return _rows(docs, "style int, fmt int, code string", lambda c: ((i, *f) for i, f in enumerate(_cell_formats(Package(c)))))


def xlsx_texts(docs: DataFrame, style_aware: bool = True, uses_1904: bool = False) -> DataFrame:
    """(doc_id, sheet, row, col, text): what cells show. A workbook is opened once; its strings and formats are looked up where
    it is read, and nothing is shuffled."""

    def make(content: bytes):
        package = Package(content)
        strings, formats = X.Styles(package).strings, dict(enumerate(_cell_formats(package)))
        for n, (_, part) in enumerate(X.sheet_parts(package), 1):
            for seq, c in enumerate(X.sheet_cells(package.required(part))):
                raw = c["raw"]
                key = int(raw) if c["kind"] == "s" and raw and raw.isascii() and raw.isdigit() else -1
                yield n, c["row"], c["col"], c["kind"], raw, c["inline"], strings[key] if 0 <= key < len(strings) else None, *formats.get(c["style"], (None, None)), seq

    wide = _rows(docs, "sheet int, row int, col int, kind string, raw string, inline string, value string, fmt int, code string, seq int", make)
    wide = wide.withColumn("hint", N.format_hint(F.col("fmt"), F.coalesce("code", N.builtin_format(F.col("fmt"))))).withColumn("number", F.col("raw").try_cast("double"))
    hint, number = F.col("hint"), F.col("number")
    shown = N.render_number(F.col("raw"), hint, uses_1904) if style_aware else F.when(F.coalesce(hint["kind"] == "date", F.lit(False)), "").otherwise(F.col("raw"))
    text = (
        F.when(F.col("kind") == "inlineStr", F.col("inline"))
        .when(F.col("kind") == "s", F.coalesce("value", "raw"))
        .when(F.col("kind") == "b", F.when(F.trim("raw") == "1", "true").otherwise("false"))
        .when(F.col("kind").isin("str", "e") | number.isNull(), F.col("raw"))
        .otherwise(shown)
    )
    return wide.select("doc_id", "sheet", "row", "col", F.coalesce(text, F.lit("")).alias("text"), "seq")


def pdf_links(docs: DataFrame) -> DataFrame:
    """Link annotations with an address: page (from 1), url, x, y, width, height."""

    def make(content: bytes):
        doc = pdf.Document(content)
        for n, page in enumerate(doc.pages(), 1):
            for x in pdf.page_links(doc, page):
                yield n, x["url"], x["x"], x["y"], x["width"], x["height"]

    return _rows(docs, "page int, url string, x double, y double, width double, height double", make)


def pdf_fields(docs: DataFrame) -> DataFrame:
    """Form fields with a value: page (from 1), name, text, x, y, width."""
    return _rows(docs, "page int, name string, text string, x double, y double, width double", lambda c: ((f["page"], f["name"], f["text"], f["x"], f["y"], f["width"]) for f in pdf.form_fields(pdf.Document(c))))


def pdf_pages(docs: DataFrame) -> DataFrame:
    """Every page by itself: page (from 1), markdown, needs_ocr."""
    return _rows(docs, "page int, markdown string, needs_ocr boolean", lambda c: ((p["page"], p["markdown"], p["needs_ocr"]) for p in pdf.pages_markdown(c)))


def pdf_layout(docs: DataFrame) -> DataFrame:
    """(doc_id, layout, error): whether a document has pages with tables or columns, and which, as JSON."""
    return _each(docs, "layout", "string", pa.string(), lambda c, _: to_json(pdf.process(c, True)["layout"]))


def pdf_items(docs: DataFrame, invisible: bool = False) -> DataFrame:
    """Positioned texts of PDF files: page (from 1), idx, text, x, y, width, font, font_size."""

    def make(content: bytes):
        doc = pdf.Document(content)
        for n, page in enumerate(doc.pages(), 1):
            for i, it in enumerate(pdf.page_items(doc, page, invisible)["items"]):
                yield n, i, it["text"], it["x"], it["y"], it["width"], it["font"], it["font_size"]

    return _rows(docs, "page int, idx int, text string, x double, y double, width double, font string, font_size double", make)


def diff_markdown(a: str, b: str, context: int = 3) -> str:
    """A unified diff of two texts."""
    import difflib

    return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "a", "b", lineterm="", n=context))


def diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(doc_id, diff) of (doc_id, a, b)."""

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([diff_markdown(x.as_py() or "", y.as_py() or "", context) for x, y in zip(a, b, strict=True)], pa.string())

    return pairs.select("doc_id", run("a", "b").alias("diff"))


def register(spark: SparkSession) -> None:
    """SQL functions: doc_format, doc_markdown, doc_ir_json, doc_docling_json, doc_inspect."""
    from pyspark.sql.functions import arrow_udf

    def function(name: str, make: Callable[[bytes], str]) -> None:
        def run(c: pa.Array) -> pa.Array:
            out = []
            for x in c:
                try:
                    out.append(make(x.as_py()))
                except Exception:  # null for what can't be read
                    out.append(None)
            return pa.array(out, pa.string())

        spark.udf.register(name, arrow_udf(run, "string"))

    function("doc_format", lambda c: "." + resolve_format(c))
    function("doc_markdown", lambda c: to_markdown(c))
    function("doc_ir_json", lambda c: to_json(extract(c, light=True)))
    function("doc_docling_json", lambda c: to_json(D.convert(extract(c, light=True))))
    function("doc_inspect", lambda c: to_json(inspect(c)))

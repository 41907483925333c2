"""Paths, relationships and content types of package parts, as column expressions and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import literal_pattern


def rels_path(part: Column) -> Column:
    """a/b.xml to a/_rels/b.xml.rels."""
    return F.regexp_replace(part, r"^(.*/)?([^/]*)$", "$1_rels/$2.rels")


def base_dir(part: Column) -> Column:
    return F.regexp_extract(part, r"^(.*)/[^/]*$", 1)


def is_external(target: Column, mode: Column | None = None) -> Column:
    link = F.lower(target).rlike("^(https?://|mailto:)")
    return link if mode is None else F.coalesce(F.lower(mode) == "external", F.lit(False)) | link


def normalize_target(base: Column, target: Column, mode: Column | None = None) -> Column:
    """The part that a relationship's target names; external targets stay as they are."""
    path = F.when(F.startswith(target, F.lit("/")), target).when(F.startswith(target, F.concat(base, F.lit("/"))) & (base != ""), target).otherwise(F.concat(base, F.lit("/"), target))

    def step(done: Column, name: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name.isin("", "."), done).when(name == "..", up).otherwise(F.array_append(done, name))

    inner = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(is_external(target, mode), target).otherwise(inner)


def resolved(rels: DataFrame) -> DataFrame:
    """rels(doc_id, source_part, rel_id, rel_type, target, mode) with path and external."""
    return rels.withColumn("external", is_external(F.col("target"), F.col("mode"))).withColumn("path", normalize_target(base_dir(F.col("source_part")), F.col("target"), F.col("mode")))


def content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """parts(doc_id, part_name) with content_type: that of the part, else that of its extension."""
    ext = F.lower(F.regexp_extract("part_name", r"\.([^./]+)$", 1))
    return (
        parts.withColumn("ext", ext)
        .join(overrides.select("doc_id", "part_name", F.col("content_type").alias("own")), ["doc_id", "part_name"], "left")
        .join(defaults.select("doc_id", "ext", F.col("content_type").alias("by_ext")), ["doc_id", "ext"], "left")
        .withColumn("content_type", F.coalesce("own", "by_ext"))
        .drop("ext", "own", "by_ext")
    )


def detected_format(parts: DataFrame) -> DataFrame:
    """(doc_id, format): by the main part, in the order docx, xlsx, pptx."""
    has = lambda name: F.max((F.col("part_name") == name).cast("int")) == 1
    return parts.groupBy("doc_id").agg(
        F.when(has("word/document.xml"), "docx").when(has("xl/workbook.xml"), "xlsx").when(has("ppt/presentation.xml"), "pptx").alias("format")
    )


def format_of_path(path: Column) -> Column:
    return parse_format(F.regexp_extract(path, r"\.([^./]+)$", 1))


def parse_format(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.trim(name)), r"^\.", "")
    return F.when(n.isin("docx", "xlsx", "csv", "pptx", "pdf"), n)


def looks_like_pdf(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return head.rlike("^(\\xEF\\xBB\\xBF)?[\\t\\n\\f\\r ]*%PDF-")


def rewrite_sheet_refs(formula: Column, old: str, new: str) -> Column:
    """References to a sheet after its renaming: quoted ones, then plain ones."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    plain = new if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", new) else quoted(new)
    out = F.replace(formula, F.lit(quoted(old) + "!"), F.lit(plain + "!"))
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_.'])"), literal_pattern(F.lit(old)), F.lit("!"))
    return F.regexp_replace(out, pattern, F.lit(plain.replace("\\", "\\\\").replace("$", "\\$") + "!"))

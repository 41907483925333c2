"""Secret scans with DataFrame functions only: fixed patterns, and corpus-wide ownership frequency of what they find.

Every candidate value is hashed; its distinct repositories (doc_id) and owners (source) are counted over the corpus. A
value that EXAMPLE_OWNERS owners or more have is a widely copied example, another one looks live. Long keys of letters and
digits that no pattern names are candidates, too; those that look live are added as spans of kind "key".

Defined results for odd input: a null or empty text has no span; a null source is an owner of its own; rows that repeat a
doc_id are scanned each, and equal ones count as one repository; a null doc_id is kept; further columns are ignored; an
empty table gives no rows. Matches that overlap others of their kind are never retried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "key")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is long enough from its start is found whole; a shorter one has no longer one in it
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}"
EXAMPLE_OWNERS = 3
SPAN = "struct<kind:string,start:bigint,end:bigint,value:bigint>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _spans(kind: str, pattern: str, text: str, may: str, value: int = 0, least: int = 0) -> Column:
    """Spans of all matches, from the lengths of what lies between them. may: a cheap test that holds where there is one."""
    p = f"'{_quoted(pattern)}'"
    values = f"regexp_extract_all({text}, {p}, {value})" if value else f"regexp_extract_all({text}, {p}, 0)"
    none = f"cast(array() as array<{SPAN}>)"
    return F.expr(
        f"""case when {may} then filter(aggregate(
            arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), {values}),
            named_struct('at', 0L, 'out', {none}),
            (acc, x) -> if(x.`1` is null, acc, named_struct(
                'at', acc.at + length(x.`0`) + length(x.`1`),
                'out', array_append(acc.out, named_struct('kind', if(length(x.`2`) >= {least}, '{kind}', ''), 'start', acc.at + length(x.`0`),
                    'end', acc.at + length(x.`0`) + length(x.`1`), 'value', xxhash64(x.`2`))))),
            acc -> acc.out), s -> s.kind <> '') else {none} end"""
    )


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, owner, base, keys): spans of the patterns, and of the long keys that touch none of them."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    low = "lower(t)"
    may = " or ".join(f"contains({low}, '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    base = F.concat(
        _spans("assign", ASSIGN, "t", f"({may})", 1, 6),
        _spans("access", ACCESS, "t", "contains(t, 'AKIA')"),
        _spans("hex", HEX, "t", "rlike(t, '[0-9a-f]{24}')"),
    )
    keys = _spans("key", KEY, "t", f"rlike(t, '{_quoted(KEY)}')")
    out = t.select("doc_id", "owner", "t", base.alias("base"), keys.alias("found"))
    # a key has letters and digits, and stands beside the base spans
    own = F.expr(
        "filter(found, k -> rlike(substring(t, cast(k.start + 1 as int), cast(k.end - k.start as int)), '[0-9]') and rlike(substring(t, cast(k.start + 1 as int), cast(k.end - k.start as int)), '[A-Za-z]')"
        " and not exists(base, b -> k.start < b.end and b.start < k.end))"
    )
    return out.select("doc_id", "owner", "base", F.when(F.size("found") > 0, own).otherwise(F.col("found")).alias("keys"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners): of every candidate value, how many distinct ones have it; combined before each shuffle."""
    each = found.select("doc_id", "owner", F.explode(F.concat("base", "keys")).alias("s")).select(F.col("s.value").alias("value"), "owner", "doc_id").distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, owner: str = "source") -> DataFrame:
    """A row for each document: doc_id and spans, an array of (kind, start, end, value, repositories, owners, live)."""
    found = cut(scan(docs, owner)).withColumn("row", F.monotonically_increasing_id())  # over a checkpoint: always the same
    each = found.where(F.size("base") + F.size("keys") > 0).select("row", F.explode(F.concat("base", "keys")).alias("s"))
    rated = each.select("row", "s", F.col("s.value").alias("value")).join(ownership(found), "value")
    kept = rated.select("row", F.struct("s.kind", "s.start", "s.end", "value", "repositories", "owners", (F.col("owners") < example_owners).alias("live")).alias("s")).where("s.kind <> 'key' or s.live")
    by_row = kept.groupBy("row").agg(F.collect_list("s").alias("spans"))
    none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:bigint,repositories:bigint,owners:bigint,live:boolean>>)"
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", F.expr(none)).alias("spans"))


def _joined(spans: str) -> str:
    order = f"array_position(array({', '.join(repr(k) for k in KINDS)}), s.kind)"
    return f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start as a, {order} as o, s.end as b, s.kind as k))), s -> concat_ws(':', s.k, cast(s.a as string), cast(s.b as string))), ',')"


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans joined, from the result of secrets."""
    n = lambda k, more="": F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}'{more})) as long)")
    base = "filter(spans, s -> s.kind <> 'key')"
    return found.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.expr(_joined(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.live)) as long)").alias("n_live"),
        F.expr("cast(size(filter(spans, s -> not s.live)) as long)").alias("n_example"),
    )

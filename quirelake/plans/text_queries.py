"""Queries of the text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..session import table


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line: the id, line_no from 0, line."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def lines_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of the lines of every document, and the quality of its text."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    line = F.col("line")
    one = lambda test: F.sum(test.cast("int"))
    counts = lines_of(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), one(T.is_caption_line(line)).alias("n_captions"), one(T.is_list_item(line)).alias("n_list_items"),
        one(T.is_code_like(line)).alias("n_code"), one(T.is_page_number_line(line)).alias("n_page_numbers"), one(T.trim(line) == "").alias("n_blank"),
    )
    return counts.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_lines", "n_captions", "n_list_items", "n_code", "n_page_numbers", "n_blank")))


LINES_CLASSIFIED = r"""
select doc_id, cast(count(*) as bigint) n_lines,
  cast(sum(case when regexp_matches(t, '^(Figura |Fig\. |Fig |Tabela |Source:|Fonte:|Source |Fonte |Note:|Nota:|Chart |Gráfico |Graph |Diagram |Image |Imagem |Photo |Foto )')
    or regexp_matches(lower(t), '^(figure|table) \s*[0-9(#]') or starts_with(lower(t), 'source:') then 1 else 0 end) as bigint) n_captions,
  cast(sum(case when regexp_matches(line, '^\s*[•●○◦*-] ') or (regexp_matches(substr(ltrim(line), 1, 5), '[0-9]') and regexp_matches(substr(ltrim(line), 1, 5), '^[0-9]*[.)]'))
    or regexp_matches(line, '^\s*([A-Za-z][.)]|\(.\))') then 1 else 0 end) as bigint) n_list_items,
  cast(sum(case when regexp_matches(t, '^(import |export |from |const |let |var |function |class |def |pub fn |fn |async fn |impl |=> |-> |:: |:= )')
    or (length(regexp_replace(t, '[^{}()\[\];=<>]', '', 'g')) >= 3 and strlen(t) < 200) or regexp_matches(t, '[;{}]$') then 1 else 0 end) as bigint) n_code,
  cast(sum(case when regexp_matches(t, '^[0-9]{1,4}$') or regexp_matches(lower(t), '^page\s*(of$|of |[0-9]|$)') or regexp_matches(t, '^[0-9]+\s* of \s*[0-9]+$')
    or regexp_matches(t, '^-\s*[0-9]+\s*-$') then 1 else 0 end) as bigint) n_page_numbers,
  cast(sum(case when t = '' then 1 else 0 end) as bigint) n_blank
from (select doc_id, line, regexp_replace(regexp_replace(line, '^[\s\x{85}\x{A0}]+', ''), '[\s\x{85}\x{A0}]+$', '') t
  from (select doc_id, unnest(string_split(text, chr(10))) line from documents))
group by doc_id"""


def garbage_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality flags of texts, by label."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    t = F.col("text")
    flagged = docs.select("doc_id", T.is_garbage_text(t).alias("garbage"), T.detect_encoding_issues(t).alias("encoding"), T.is_rtl_text(t).alias("rtl"))
    return labels.join(flagged, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("int")).alias(c) for c in ("garbage", "encoding", "rtl")))


GARBAGE_QUALITY = r"""
select quality, count(*) n, sum(cast(g + r >= 50 and g * 2 < g + r as int)) garbage,
  sum(cast(fffd or (dollars > 10 and (pairs > 20 or pairs * 2 > dollars)) as int)) encoding, sum(0) rtl
from (select doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) g, length(regexp_replace(text, '[\s\x{85}\p{Z}#*|\-\p{L}\p{N}]', '', 'g')) r,
    contains(text, chr(65533)) fffd, length(text) - length(replace(text, '$', '')) dollars,
    (length(text) - length(regexp_replace(regexp_replace(text, '([A-Za-z])\$([A-Za-z])', '\1\2', 'g'), '([A-Za-z])\$([A-Za-z])', '\1\2', 'g'))) pairs
  from documents) join labels using (doc_id) group by quality"""

#: Puts what the synthetic texts lack into them, so that the cleaning has something to do.
DIRTY = "concat('Contents ........ 7\n\n\n\n12\n\nwell - known  word  \nsee http://host.example/a?b=1, now\n\n', text)"


def clean_markdown(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr(DIRTY)
    cleaned = T.clean_markdown(t, page_numbers=False)
    return table(spark, sf, "documents").select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("long").alias("n_clean"))


CLEAN_MARKDOWN = r"""
select doc_id, md5(c) digest, cast(length(c) as bigint) n_clean from (
  select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    'Contents ........ 7' || repeat(chr(10), 4) || '12' || repeat(chr(10), 2) || 'well - known  word  ' || chr(10) || 'see http://host.example/a?b=1, now' || repeat(chr(10), 2) || text,
    '\.{4,}', ' ... ', 'g'), '([a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ]) - ([a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ])', '\1-\2', 'g'),
    '(https?://[^\s<>)\]]+[^\s<>)\].,;])', '[\1](\1)', 'g'), '([^ \n]) {2,}', '\1 ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') || chr(10) c
  from documents)"""


def page_numbers_removed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    t = F.concat(F.lit("- 3 -\n\n"), F.col("text"), F.lit("\n\n17\n\nPage 2 of 9\n---\nend 4\n5 of 6"))
    out = T.remove_page_numbers(t)
    return docs.select("doc_id", F.length(out).cast("long").alias("n_left"), F.md5(out).alias("digest"))


PAGE_NUMBERS_REMOVED = r"""
with l as (select doc_id, unnest(string_split('- 3 -' || chr(10) || chr(10) || text || repeat(chr(10), 2) || '17' || repeat(chr(10), 2) || 'Page 2 of 9' || chr(10) || '---' || chr(10) || 'end 4' || chr(10) || '5 of 6', chr(10))) line,
    generate_subscripts(string_split('- 3 -' || chr(10) || chr(10) || text || repeat(chr(10), 2) || '17' || repeat(chr(10), 2) || 'Page 2 of 9' || chr(10) || '---' || chr(10) || 'end 4' || chr(10) || '5 of 6', chr(10)), 1) n from documents),
w as (select *, trim(line) t, trim(lag(line) over d) p, trim(lead(line) over d) q, trim(lead(line, 2) over d) q2 from l window d as (partition by doc_id order by n)),
k as (select * from w where not ((regexp_matches(t, '^[0-9]{1,4}$') or regexp_matches(lower(t), '^page\s*(of$|of |[0-9]|$)') or regexp_matches(t, '^[0-9]+\s* of \s*[0-9]+$') or regexp_matches(t, '^-\s*[0-9]+\s*-$'))
  and (((p is null or p in ('', '---')) and (q is null or q in ('', '---'))) or coalesce(q = '---', false) or coalesce(q = '' and q2 = '---', false))))
select doc_id, cast(length(o) as bigint) n_left, md5(o) digest from (select doc_id, string_agg(line, chr(10) order by n) o from k group by doc_id)"""


def url_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.format_urls(F.concat(F.lit("see "), F.col("url"), F.lit(", then"))).alias("link"))


URL_LINKS = r"""select page_id, regexp_replace('see ' || url || ', then', '(https?://[^\s<>)\]]+[^\s<>)\].,;])', '[\1](\1)', 'g') link from pages"""


def ligatures_expanded(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("ﬁn­al ﬃx​ "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.expand_ligatures(t)).alias("digest"))


LIGATURES_EXPANDED = "select doc_id, md5('final ffix ' || text) digest from documents"


def xml_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text nodes of paragraphs, unescaped and escaped again."""
    nodes = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<p[^>]*>([^<]*)</p>"), F.lit(1))).alias("n", "raw"))
    plain = T.xml_unescape(F.col("raw"))
    return nodes.select("page_id", F.col("n").cast("long").alias("n"), plain.alias("plain"), (T.xml_escape(plain) == F.col("raw")).alias("same"))


_UN = "replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
XML_TEXT = rf"""
select page_id, cast(n - 1 as bigint) n, {_UN} plain,
  replace(replace(replace(replace(replace({_UN}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') = raw same
from (select page_id, unnest(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1)) raw, generate_subscripts(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), 1) n from pages)"""


def replace_all_report(spark: SparkSession, sf: str) -> DataFrame:
    """Literal replacement in every turn, with what it did by conversation."""
    t = F.col("text")
    hits = T.occurrences(t, "the")
    parts = table(spark, sf, "conversations").select("conv_id", hits.alias("hits"), F.length(T.replace_text(t, "the", "[THE]")).alias("n"))
    return parts.groupBy("conv_id").agg(F.count("*").alias("parts_scanned"), F.sum((F.col("hits") > 0).cast("int")).alias("parts_modified"), F.sum("hits").alias("replacements_applied"), F.sum("n").alias("n_chars"))


REPLACE_ALL_REPORT = """
select conv_id, count(*) parts_scanned, sum(cast(h > 0 as int)) parts_modified, sum(h) replacements_applied, sum(length(text) + 2 * h) n_chars
from (select conv_id, text, (length(text) - length(replace(text, 'the', ''))) // 3 h from conversations) group by conv_id"""


def replace_ignoring_case(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.replace_text(t, "THE", "<$0>", "ignore_case")).alias("digest"), T.occurrences(t, "THE", "ignore_case").cast("long").alias("hits"), F.md5(T.replace_text(t, "e", "E", first=True)).alias("first_only"))


REPLACE_IGNORING_CASE = r"""
select conv_id, turn, md5(regexp_replace(text, '([tT][hH][eE])', '<\1>', 'g')) digest, cast(len(regexp_extract_all(text, '[tT][hH][eE]')) as bigint) hits, md5(regexp_replace(text, 'e', 'E')) first_only from conversations"""


def replace_whole_words(spark: SparkSession, sf: str) -> DataFrame:
    t = F.regexp_replace("text", "[^\\x00-\\x7F]", "#")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.replace_text(t, "the", "a", "whole_word")).alias("digest"), T.occurrences(t, "the", "whole_word").cast("long").alias("hits"))


REPLACE_WHOLE_WORDS = r"""
select conv_id, turn, md5(regexp_replace(t, '\bthe\b', 'a', 'g')) digest, cast(len(regexp_extract_all(t, '\bthe\b')) as bigint) hits
from (select conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '#', 'g') t from conversations)"""


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at the edges of pages that stand on at least max(3, 30 %) of a host's pages: running headers and footers."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n").alias("ls"))
    edge = pages.select("page_id", "host", F.explode(F.concat(F.slice("ls", 1, 12), F.slice(F.reverse("ls"), 1, 12))).alias("line"))
    norm = edge.select("page_id", "host", T.normalize_for_comparison(F.col("line")).alias("line")).where("line <> ''")
    total = pages.groupBy("host").agg(F.count_distinct("page_id").alias("pages"))
    seen = norm.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return seen.join(total, "host").where("n >= greatest(3, ceil(pages * 0.3))").select("host", "line", "n", "pages")


REPEATED_LINES = r"""
with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) ls from pages),
e as (select page_id, host, unnest(list_concat(ls[1:12], list_reverse(ls)[1:12])) line from p),
m as (select distinct page_id, host, trim(regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '^[0-9]+', ''), '[0-9]+$', '')) line from e),
t as (select host, count(distinct page_id) pages from p group by host)
select host, line, n, pages from (select host, line, count(*) n from m where line <> '' group by host, line) join t using (host) where n >= greatest(3, ceil(pages * 0.3))"""


def plain_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and fenced code: a fence opens before the first code line of a run and closes after the last."""
    docs = table(spark, sf, "documents")
    d = W.partitionBy("doc_id").orderBy("line_no")
    line = F.col("line")
    marked = lines_of(docs).withColumn("code", T.is_code_like(line)).withColumn("was", F.coalesce(F.lag("code").over(d), F.lit(False))).withColumn("next", F.coalesce(F.lead("code").over(d), F.lit(False)))
    body = F.when(F.col("code"), line).when(T.is_list_item(line), T.format_list_item(line)).otherwise(line)
    out = F.concat(F.when(F.col("code") & ~F.col("was"), "```\n").otherwise(""), body, F.when(F.col("code") & ~F.col("next"), "\n```").otherwise(""))
    rows = marked.select("doc_id", F.struct("line_no", out.alias("o")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["o"]), "\n").alias("md")).select("doc_id", F.md5("md").alias("digest"), F.length("md").cast("long").alias("n_chars"))


PLAIN_TO_MARKDOWN = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents),
c as (select *, regexp_replace(regexp_replace(line, '^[\s\x{85}\x{A0}]+', ''), '[\s\x{85}\x{A0}]+$', '') t from l),
k as (select *, regexp_matches(t, '^(import |export |from |const |let |var |function |class |def |pub fn |fn |async fn |impl |=> |-> |:: |:= )')
    or (length(regexp_replace(t, '[^{}()\[\];=<>]', '', 'g')) >= 3 and strlen(t) < 200) or regexp_matches(t, '[;{}]$') code,
  regexp_matches(line, '^\s*[•●○◦*-] ') or (regexp_matches(substr(ltrim(line), 1, 5), '[0-9]') and regexp_matches(substr(ltrim(line), 1, 5), '^[0-9]*[.)]')) or regexp_matches(line, '^\s*([A-Za-z][.)]|\(.\))') item from c),
w as (select *, coalesce(lag(code) over d, false) was, coalesce(lead(code) over d, false) nxt from k window d as (partition by doc_id order by n)),
o as (select doc_id, n, (case when code and not was then '```' || chr(10) else '' end) || (case when code then line when item then regexp_replace(ltrim(line), '^(\*{0,2})[•●○◦]\s*', '- \1') else line end) || (case when code and not nxt then chr(10) || '```' else '' end) o from w),
m as (select doc_id, string_agg(o, chr(10) order by n) md from o group by doc_id)
select doc_id, md5(md) digest, cast(length(md) as bigint) n_chars from m"""


def font_names(spark: SparkSession, sf: str) -> DataFrame:
    """Font-name classes, over names made of part brands and types."""
    raw = F.concat(F.lit("/ABCDEF+"), F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, "-BoldItalic").when(F.col("p_partkey") % 5 == 1, "-Medium").when(F.col("p_partkey") % 5 == 2, "Courier-Oblique").otherwise(""))
    name = T.normalize_font_name(raw)
    return table(spark, sf, "part").select("p_partkey", name.alias("font"), T.is_bold_font(name).alias("bold"), T.is_italic_font(name).alias("italic"), T.is_monospace_font(name).alias("mono"))


FONT_NAMES = """
select p_partkey, font, regexp_matches(lower(font), 'bold|-bd|_bd|black|heavy|demi-bold|semi-bold') or (contains(lower(font), 'medium') and not contains(lower(font), 'mediumitalic')) bold,
  regexp_matches(lower(font), 'italic|oblique|-it|_it|slant|inclined|kursiv') italic,
  regexp_matches(lower(font), 'courier|consolas|monaco|menlo|mono|fixed|terminal|typewriter|source code|fira code|jetbrains|inconsolata') mono
from (select p_partkey, p_type || case p_partkey % 5 when 0 then '-BoldItalic' when 1 then '-Medium' when 2 then 'Courier-Oblique' else '' end font from part)"""


def cid_garbage(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", "[a-m]", "\u0093")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.is_cid_garbage(t).alias("garbage"))


CID_GARBAGE = r"""
select doc_id, (g + r >= 50 and g * 2 < g + r) or (n >= 5 and (c * 20 >= n or (h * 5 >= n * 2 and a * 3 < n))) garbage
from (select doc_id, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) g, length(regexp_replace(t, '[\s\x{85}\p{Z}#*|\-\p{L}\p{N}]', '', 'g')) r,
    length(regexp_replace(t, '[\s\x{85}\p{Z}]', '', 'g')) n, length(regexp_replace(t, '[^\x{80}-\x{84}\x{86}-\x{9F}]', '', 'g')) c,
    length(regexp_replace(t, '[^\x{A1}-\x{FF}]', '', 'g')) h, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) a
  from (select doc_id, case when doc_id % 7 = 0 then regexp_replace(text, '[a-m]', chr(147), 'g') else text end t from documents))"""


def decode_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.score_text(F.col("text")).cast("long").alias("score"), T.is_letterspaced(F.col("text")).alias("spaced"))


DECODE_PLAUSIBILITY = r"""
with s as (select doc_id, text, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w in ('the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'with', 'on', 'as', 'by', 'from', 'this', 'be', 'are', 'at', 'or', 'not', 'it', 'our'))) w,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) l, length(regexp_replace(text, '[^ ]', '', 'g')) s, length(regexp_replace(text, '[^0-9]', '', 'g')) d, length(regexp_replace(text, '[^\x00-\x1F\x7F-\x{9F}\x{FFFD}]', '', 'g')) b,
  list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') ws from documents)
select doc_id, cast(w * 10 + l + s * 2 + d - (length(text) - l - s - d - b + b * 3) * 2 - case when l > 15 and w = 0 then 15 else 0 end as bigint) score,
  len(ws) >= 4 and len(list_filter(ws, lambda x: regexp_matches(x, '^\p{L}$'))) >= len(ws) * 0.7 spaced from s"""


def symbols_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol signs and marked UTF-16 over whole texts, as digests and lengths."""
    t = F.concat(F.lit("\uf0b7\uf041\uf0fc "), F.col("text"))
    both = table(spark, sf, "documents").select("doc_id", T.clean_symbol_pua(t).alias("c"), T.decode_text_string(F.encode(t, "UTF-16")).alias("d"))
    return both.select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n_cleaned"), F.md5("d").alias("decoded"), F.length("d").cast("long").alias("n_decoded"))


SYMBOLS_CLEANED = """
select doc_id, md5(c) cleaned, cast(length(c) as bigint) n_cleaned, md5(d) decoded, cast(length(d) as bigint) n_decoded
from (select doc_id, '•A✓ ' || text c, chr(61623) || chr(61505) || chr(61692) || ' ' || text d from documents)"""

QUERIES = {
    "decode_plausibility": (decode_plausibility, DECODE_PLAUSIBILITY),
    "symbols_cleaned": (symbols_cleaned, SYMBOLS_CLEANED),
    "lines_classified": (lines_classified, LINES_CLASSIFIED),
    "garbage_quality": (garbage_quality, GARBAGE_QUALITY),
    "clean_markdown": (clean_markdown, CLEAN_MARKDOWN),
    "page_numbers_removed": (page_numbers_removed, PAGE_NUMBERS_REMOVED),
    "url_links": (url_links, URL_LINKS),
    "ligatures_expanded": (ligatures_expanded, LIGATURES_EXPANDED),
    "xml_text_nodes": (xml_text, XML_TEXT),
    "replace_all_report": (replace_all_report, REPLACE_ALL_REPORT),
    "replace_ignoring_case": (replace_ignoring_case, REPLACE_IGNORING_CASE),
    "replace_whole_words": (replace_whole_words, REPLACE_WHOLE_WORDS),
    "repeated_lines": (repeated_lines, REPEATED_LINES),
    "plain_to_markdown": (plain_to_markdown, PLAIN_TO_MARKDOWN),
    "font_names": (font_names, FONT_NAMES),
    "cid_garbage": (cid_garbage, CID_GARBAGE),
}

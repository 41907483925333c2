"""Queries of ordered and positional operators over the star schema, events, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import layout as L
from ..session import table


def font_mode(spark: SparkSession, sf: str) -> DataFrame:
    return L.mode_of(table(spark, sf, "part"), ["p_brand"], "p_size").select("p_brand", F.col("mode").cast("long").alias("mode"), "n")


FONT_MODE = "select p_brand, cast(p_size as bigint) mode, n from (select p_brand, p_size, count(*) n, row_number() over (partition by p_brand order by count(*) desc, p_size) r from part group by p_brand, p_size) where r = 1"


def heading_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Up to four size tiers of each brand, at least 0.5 apart and 1.2 x its smallest size."""
    own = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("sizes"), F.min("p_size").alias("base"))
    return own.select("p_brand", F.posexplode(L.tiers(F.col("sizes"), F.col("base") * 8))).select("p_brand", (F.col("pos") + 1).cast("long").alias("tier"), F.col("col").alias("size"))


HEADING_TIERS = """
select p_brand, tier, cast(p_size as double) size from (select p_brand, p_size, row_number() over (partition by p_brand order by p_size desc) tier
  from (select distinct p_brand, p_size, min(p_size) over (partition by p_brand) base from part) where p_size >= base * 8 * 1.2) where tier <= 4"""


def median_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median of the gaps between a user's events, times 1.3; 1800 seconds with fewer than 5 gaps."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).alias("gap"))
    g = gaps.groupBy("user_id").agg(F.array_sort(F.collect_list("gap")).alias("gs"))
    mid = F.element_at("gs", F.floor(F.size("gs") / 2).cast("int") + 1)
    return g.select("user_id", F.when(F.size("gs") < 5, F.lit(1800.0)).otherwise(F.round(mid / 1e6 * 1.3, 3)).alias("threshold"))


MEDIAN_GAP = """
with g as (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events),
a as (select user_id, list_sort(list(gap) filter (gap is not null)) gs from g group by user_id)
select user_id, case when coalesce(len(gs), 0) < 5 then 1800.0 else round(gs[len(gs) // 2 + 1] / 1e6 * 1.3, 3) end threshold from a"""


def line_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user within an hour of the one before are one line."""
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    marked = L.islands(e.withColumn("was", F.lag("us").over(w)), ["user_id"], ["us", "event_id"], F.col("us") - F.col("was") > 3_600_000_000)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return marked.groupBy("user_id", "island").agg(line.alias("line"), F.count("*").alias("n")).select("user_id", F.col("island").cast("long").alias("island"), "line", "n")


LINE_ISLANDS = """
with w as (select *, epoch_us(ts) us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) was from events),
i as (select *, sum(cast(coalesce(us - was > 3600000000, false) as int)) over (partition by user_id order by us, event_id rows unbounded preceding) island from w)
select user_id, cast(island as bigint) island, string_agg(event_type, ' ' order by us, event_id) line, count(*) n from i group by user_id, island"""


def continuation_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Tables on consecutive pages with as many columns are one: orders of a customer by line count."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("cols"))
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("doc")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    w = W.partitionBy("doc").orderBy("o_orderkey")
    marked = L.islands(o.withColumn("p", F.lag("o_orderkey").over(w)).withColumn("c", F.lag("cols").over(w)), ["doc"], ["o_orderkey"], (F.col("o_orderkey") - F.col("p") > 50) | (F.col("c") != F.col("cols")))
    return marked.groupBy("doc", "island").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("pages")).select("doc", F.col("island").cast("long").alias("island"), "first", "pages")


CONTINUATION_MERGE = """
with o as (select o_orderkey, o_orderkey % 50 doc, cols from orders join (select l_orderkey, count(*) cols from lineitem group by 1) on l_orderkey = o_orderkey),
w as (select *, lag(o_orderkey) over d p, lag(cols) over d c from o window d as (partition by doc order by o_orderkey)),
i as (select *, sum(cast(coalesce(o_orderkey - p > 50 or c <> cols, false) as int)) over (partition by doc order by o_orderkey rows unbounded preceding) island from w)
select doc, cast(island as bigint) island, min(o_orderkey) as first, count(*) pages from i group by doc, island"""


def filled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of each conversation on every other page, with empty pages between."""
    c = table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg((F.max("turn") * 2 + 2).cast("int").alias("n"))
    spread = c.join(n, "conv_id").select("conv_id", (F.col("turn") * 2 + 1).cast("int").alias("page"), "text", F.col("turn").alias("ord"), "n")
    return L.filled_pages(spread, "conv_id", "n").select("conv_id", F.col("page").cast("long").alias("page"), "text")


FILLED_PAGES = """
with e as (select conv_id, unnest(range(1, max(turn) * 2 + 3)) page from conversations group by conv_id)
select e.conv_id, cast(page as bigint) page, coalesce(text, '') as text from e left join conversations c on c.conv_id = e.conv_id and c.turn * 2 + 1 = page"""


def grid_range(spark: SparkSession, sf: str) -> DataFrame:
    """Prices into the first interval that holds them."""
    edges = F.array(*(F.lit(float(x)) for x in (900, 1000, 1200, 1500, 1900)))
    p = table(spark, sf, "part")
    return p.select("p_partkey", L.interval_of(F.col("p_retailprice"), edges, 2.0).cast("long").alias("cell"))


GRID_RANGE = """select p_partkey, cast(case when p_retailprice >= 898 and p_retailprice < 1002 then 0 when p_retailprice >= 998 and p_retailprice < 1202 then 1 when p_retailprice >= 1198 and p_retailprice < 1502 then 2 when p_retailprice >= 1498 and p_retailprice < 1902 then 3 end as bigint) cell from part"""


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of customers' spending windows in a nation, as an equi-join on cells."""
    o = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("a"), F.col("c_acctbal").alias("a1"), (F.col("c_acctbal") + 150).alias("a2"))
    r = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("b1"), (F.col("s_acctbal") + 400).alias("b2"))
    return L.overlapping(o, r, "k", ("a1", "a2"), ("b1", "b2"), 500.0).select("k", "a", "b")


INTERVAL_OVERLAP = """select c_nationkey k, c_custkey a, s_suppkey b from customer join supplier on s_nationkey = c_nationkey and c_acctbal <= s_acctbal + 400 and s_acctbal <= c_acctbal + 150"""


def nearest_column(spark: SparkSession, sf: str) -> DataFrame:
    centres = F.array(*(F.lit(float(x)) for x in (5, 15, 30, 48)))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(L.nearest(F.col("p_size").cast("double"), centres, F.lit(6.0)).cast("long"), F.lit(-1)).alias("col"))


NEAREST_COLUMN = """select p_partkey, cast(coalesce((select i from (values (5.0, 0), (15.0, 1), (30.0, 2), (48.0, 3)) c(x, i) where abs(p_size - x) <= 6 order by abs(p_size - x), i limit 1), -1) as bigint) col from part"""


def snapped_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a brand, each over 6 above the last one kept."""
    own = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("v"))
    return own.select("p_brand", F.array_join(F.transform(L.kept_edges(F.col("v"), 6.0), lambda x: x.cast("int").cast("string")), ",").alias("edges"))


SNAPPED_EDGES = """
with recursive v as (select distinct p_brand, p_size from part), k(p_brand, e) as (select p_brand, min(p_size) from v group by 1
  union all select k.p_brand, (select min(p_size) from v where v.p_brand = k.p_brand and v.p_size - k.e > 6) from k where exists (select 1 from v where v.p_brand = k.p_brand and v.p_size - k.e > 6))
select p_brand, string_agg(e, ',' order by e) edges from k group by 1"""


def sections_from_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as sections, joined into one markdown text each and split again."""
    c = table(spark, sf, "conversations")
    part = F.concat(F.lit("## Section: "), F.col("role"), F.lit("\n"), F.regexp_replace("text", "(?m)^## ", "# "))
    md = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("md"))
    lines = md.select("conv_id", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "line"))
    return L.sections(lines, "conv_id", "^## Section: ").groupBy("conv_id", "section").agg(F.max(F.when(F.col("line").rlike("^## Section: "), F.substring("line", 13, 99))).alias("name"), F.count("*").alias("n_lines")).select("conv_id", F.col("section").cast("long").alias("section"), "name", "n_lines")


SECTIONS_FROM_MARKDOWN = """select conv_id, row_number() over (partition by conv_id order by turn) as section, role as name, len(string_split(text, chr(10))) + 1 n_lines from conversations"""


def selector_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that the selector 1,3-5 names."""
    return table(spark, sf, "conversations").where(F.col("turn").isin(L.number_ranges("1,3-5"))).select("conv_id", "turn", "role")


SELECTOR_RANGES = "select conv_id, turn, role from conversations where turn in (1, 3, 4, 5)"


def slide_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title (the first line of the first turn) goes once from the paragraphs that equal it."""
    c = table(spark, sf, "conversations")
    paras = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "para"))
    title = paras.groupBy("conv_id").agg(F.min_by("para", F.struct("turn", "p")).alias("title"))
    dup = F.trim("para") == F.trim("title")
    w = W.partitionBy("conv_id", dup).orderBy("turn", "p")
    kept = paras.join(title, "conv_id").withColumn("nth", F.row_number().over(w)).where(~(dup & (F.col("nth") == 1)))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"))


SLIDE_TITLES = "select conv_id, count(*) - 1 n from (select conv_id, unnest(string_split(text, chr(10))) p from conversations) group by 1 having count(*) > 1"


def inspect_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What there is in each source: documents, languages, characters, largest."""
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


INSPECT_SUMMARY = "select source, count(*) documents, count(distinct lang) langs, sum(n_chars) chars, max(n_chars) largest, string_agg(distinct lang, ',' order by lang) as names from documents group by source"


def docling_refs(spark: SparkSession, sf: str) -> DataFrame:
    """#/texts/i references of the paragraphs of each document."""
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: T.trim(x) != "")).alias("i", "para"))
    return p.select("doc_id", F.concat(F.lit("#/texts/"), F.col("i")).alias("ref"), F.md5("para").alias("digest"))


DOCLING_REFS = r"""select doc_id, '#/texts/' || (row_number() over (partition by doc_id order by n) - 1) as ref, md5(para) digest
from (select doc_id, unnest(string_split(text, chr(10))) para, generate_subscripts(string_split(text, chr(10)), 1) n from documents) where regexp_matches(para, '[^\s\x{85}\x{A0}]')"""


def right_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The value at nine tenths of a brand's sorted sizes, and the commonest bucket of five."""
    p = table(spark, sf, "part")
    own = p.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_size")).alias("v"))
    left = L.mode_of(p.withColumn("b", F.floor(F.col("p_size") / 5) * 5), ["p_brand"], "b")
    return own.join(left, "p_brand").select("p_brand", F.element_at("v", F.floor(F.size("v") * 9 / 10).cast("int") + 1).cast("long").alias("right"), F.col("mode").cast("long").alias("left"))


RIGHT_MARGIN = """
with v as (select p_brand, list_sort(list(p_size)) v from part group by 1), b as (select p_brand, p_size // 5 * 5 b, count(*) n from part group by 1, 2),
m as (select p_brand, b, row_number() over (partition by p_brand order by n desc, b) r from b)
select v.p_brand, cast(v[len(v) * 9 // 10 + 1] as bigint) as "right", cast(b as bigint) as "left" from v join m on m.p_brand = v.p_brand and r = 1"""

QUERIES = {
    "font_mode_like": (font_mode, FONT_MODE),
    "heading_tiers_topk": (heading_tiers, HEADING_TIERS),
    "median_gap_threshold": (median_gap, MEDIAN_GAP),
    "line_grouping_islands": (line_islands, LINE_ISLANDS),
    "continuation_merge": (continuation_merge, CONTINUATION_MERGE),
    "fill_missing_pages": (filled_pages, FILLED_PAGES),
    "grid_range_join": (grid_range, GRID_RANGE),
    "interval_overlap": (interval_overlap, INTERVAL_OVERLAP),
    "nearest_column": (nearest_column, NEAREST_COLUMN),
    "snapped_edges": (snapped_edges, SNAPPED_EDGES),
    "sections_from_markdown": (sections_from_markdown, SECTIONS_FROM_MARKDOWN),
    "selector_ranges": (selector_ranges, SELECTOR_RANGES),
    "slide_title_dedup": (slide_titles, SLIDE_TITLES),
    "inspect_summary": (inspect_summary, INSPECT_SUMMARY),
    "docling_refs": (docling_refs, DOCLING_REFS),
    "page_margins": (right_margin, RIGHT_MARGIN),
}

"""The registered queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    from .common import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_turns, read_back

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return read_back(format_turns(own.unionByName(more)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rollup import token_totals

    return token_totals(_table(spark, sf_dir, "documents"), _folder(spark, "token-totals"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import write_shards

    return write_shards(_table(spark, sf_dir, "documents"), _folder(spark, "shards"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secrets

    return digest(secrets(_table(spark, sf_dir, "documents")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iblt import against_next

    return against_next(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, digest

    return digest(detect(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_training_order": op6_training_order,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scans": op8_secret_scans,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_personal_data": op10_personal_data,
}

_CHAT_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(14 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + length(text) + len(regexp_extract_all(text, '(?m)^\\*(?:### |</turn>)'))) as bigint) formatted_chars
from t group by conv_id"""

_SECRETS_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, row_number() over () r from documents),
p(k, o, x, g) as (values ('assign', 1, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), ('access', 2, '(AKIA[A-Z0-9]{16,})', 1),
  ('hex', 3, '([0-9a-f]{24,})', 1), ('key', 4, '([A-Za-z0-9_-]{24,})', 1)),
m as (select doc_id, source, r, k, o, string_split_regex(t, x) b, regexp_extract_all(t, x, 0) w, regexp_extract_all(t, x, 1) v from d, p where regexp_matches(t, x)),
i as (select *, unnest(range(1, len(w) + 1)) n from m),
s as (select doc_id, source, r, k, o, w[n] as w, v[n] as v, cast(list_sum(list_transform(b[1:n], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:n - 1], lambda y: length(y))), 0) as bigint) a from i),
base as (select *, a + length(w) e from s where k <> 'key' and (k <> 'assign' or length(v) >= 6)),
own as (select *, a + length(w) e from s where k = 'key' and regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Za-z]')
  and not exists (select 1 from base where base.r = s.r and s.a < base.e and base.a < s.a + length(s.w))),
every as (select * from base union all select * from own),
rated as (select v, count(distinct coalesce(source, '<none>')) owners from every group by v),
kept as (select every.*, owners < 3 live from every join rated using (v) where k <> 'key' or owners < 3),
j as (select r, count(*) filter (k = 'assign') n_assign, count(*) filter (k = 'access') n_access, count(*) filter (k = 'hex') n_hex,
  string_agg(k || ':' || a || ':' || e, ',' order by a, o) filter (k <> 'key') base, string_agg(k || ':' || a || ':' || e, ',' order by a, o) spans,
  count(*) filter (live) n_live, count(*) filter (not live) n_example from kept group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example from d left join j using (r)"""

#: Fingerprints, token ids, chains and sketches are not expressible in SQL; their tests hold them against brute force.
SQL: dict[str, str] = {"op2_chat_formatting": _CHAT_SQL, "op8_secret_scans": _SECRETS_SQL}

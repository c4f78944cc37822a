"""The queries opN_<name> with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, language_id, mixing, near_dedup, quality, substring_dedup, token_count, url_filter
from .common import table

#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites whose pages are blocked where no rule fits.
LISTED_SITES = [(f"{name}.example.{top}", "") for name in ("adult-x", "casino-win", "free-bets", "spam-farm") for top in ("com", "net", "org")]
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("d")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_doc", "p_host", "p_path", "p_bad", "keep")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    listed = spark.createDataFrame(LISTED_SITES, "host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select(F.col("id").alias("doc_id"), "class_id", "group_rows", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out("doc_id"))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), docs.where("not held_out and doc_id is not null"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, token_count.default_model())


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(EXTRA_CONVERSATION, rows.schema))
    return chat_format.digests(chat_format.format_chats(chat_format.chain(rows)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_pass", "mix_block", "mix_order.block", "mix_order.row")


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality, op3_url_filter, op4_near_dedup, op5_decontamination, op6_embedding_dedup, op7_language_id, op8_token_counts, op9_chat_formatting, op10_mixing)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_URL_SQL = rf"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, row_number() OVER () AS k, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u AS (SELECT page_id, k, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM q),
rules(verdict, host, path) AS (VALUES {_values(URL_RULES)}),
listed(host, path) AS (VALUES {_values(LISTED_SITES)}),
fit AS (
  SELECT u.k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.k ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS n
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
bad AS (SELECT u.k, max(l.host || l.path) AS listed FROM u JOIN listed l ON (u.host = l.host OR ends_with(u.host, '.' || l.host)) AND starts_with(u.path, l.path) GROUP BY u.k)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, CASE WHEN bad.listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, bad.listed
FROM u LEFT JOIN fit ON fit.k = u.k AND fit.n = 1 LEFT JOIN bad ON bad.k = u.k
"""

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[|])(s>|/s>|INST\]|/INST\]|\||>)', '\1\\\2', 'g') AS r2,
         regexp_replace(replace(text, '\', '\\'), '([<\[|])(s>|/s>|INST\]|/INST\]|\||>)', '\1\\\2', 'g') AS t2 FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r2) + length(t2) + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


_EMBEDDING_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.c, e.vec_id)::BIGINT AS component_id, coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": _EMBEDDING_SQL, "op3_url_filter": _URL_SQL, "op9_chat_formatting": _CHAT_SQL}

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from webloom.session import spread

from . import chat, decontam, gumbel, htmlmain, linedup, neardup, rules, shard, urlfilter, zclassify

#: The rules of the URL query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _records(turns: DataFrame) -> DataFrame:
    """The turns as JSON records of three layouts, a third of the conversations each, as they come from different sources."""
    pair = lambda role, text: F.array(F.struct(F.col("role").alias(role), F.col("text").alias(text)))
    layouts = [F.struct("role", "text"), F.struct(pair("role", "content").alias("messages")), F.struct(pair("from", "value").alias("conversations"))]
    third, (a, b, c) = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)), (F.to_json(x, {"ignoreNullFields": "false"}) for x in layouts)
    return turns.select("conv_id", "turn", F.when(third == 0, a).when(third == 1, b).otherwise(c).alias("record"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_records(_records(turns)))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = zclassify.fit(docs, _table(spark, sf_dir, "labels"), learn="crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    scored = zclassify.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 85).drop("th")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.verdicts(rules.ledger(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel.encode(_table(spark, sf_dir, "documents"), gumbel.VOCABULARY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_shard, op2_chat, op3_url_filter, op4_main_text, op5_line_dedup, op6_quality, op7_decontaminate, op8_near_duplicates, op9_quality_rules, op10_sentencepiece, pipeline)
}

_CONTROL_LENGTH = "+".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROLS))
_FRAME = len(chat.OPEN) + len(chat.CLOSE) + 2
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_chat": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, n, x, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, x))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + {_CONTROL_LENGTH} + {_FRAME})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op3_url_filter": rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row FROM pages),
fits AS (
  SELECT row, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM p JOIN (VALUES {_RULES}) r(h, q, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY row)
SELECT page_id::BIGINT AS page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (row)""",
    # the test pages have all of their main text in one article, with no other elements than these in it
    "op4_main_text": r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(1)),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id::BIGINT AS page_id, url, text, length(text)::BIGINT AS n_chars FROM b""",
    "op7_decontaminate": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT item_id, w, least(8, len(w)) AS m, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
spots AS (
  SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT row, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT row, m, i, item_id FROM spots JOIN windows USING (m, x)),
hit AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM found, generate_series(0, 7) g(k) WHERE k < m GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY row)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)""",
    "op8_near_duplicates": r"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT row, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT row, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT row, count(*) AS n FROM s GROUP BY row),
classes AS MATERIALIZED (SELECT row, n, min(row) OVER (PARTITION BY k) AS rep FROM (SELECT row, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS k FROM s GROUP BY row)),
one AS MATERIALIZED (SELECT s.* FROM s JOIN classes USING (row) WHERE row = rep),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.row AS a, b.row AS b, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.row < b.row GROUP BY 1, 2) JOIN n p ON p.row = a JOIN n q ON q.row = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT row, rep FROM classes UNION ALL SELECT rep, row FROM classes),
reach(row, other) AS (SELECT row, row FROM n UNION SELECT reach.row, b FROM reach JOIN edges ON a = other),
least AS (SELECT reach.row, min(o.doc_id) AS component FROM reach JOIN d o ON o.row = other GROUP BY reach.row)
SELECT doc_id::BIGINT AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component, doc_id) AS kept
FROM d LEFT JOIN n USING (row) LEFT JOIN least USING (row)""",
    "op9_quality_rules": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
three AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT row, i FROM three JOIN (SELECT row, x FROM three GROUP BY row, x HAVING count(*) > 1) USING (row, x)),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM again, generate_series(0, 2) g(k) GROUP BY row),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS upper, length(regexp_replace(t, '[^!]', '', 'g')) AS exclaim
  FROM w LEFT JOIN rep USING (row))
SELECT doc_id::BIGINT AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * upper > 30 * n_words OR 100 * exclaim > 30 * n_words
    OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words))) AS kept
FROM m""",
}

"""One query per operator, with production parameters over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import chat_format, decontaminate, embedding_dedup, language_id, line_dedup, lm_score, minhash_dedup, mixing, secret_scan, sharding

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def _query(plan):
    QUERIES[plan.__name__] = plan
    return plan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.assign_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def _language_model(docs: DataFrame) -> dict | None:
    return language_id.fit(docs.where(_remainder(3) != 1), F.xxhash64(F.lit("language"), "doc_id", "text"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (_remainder(3) == 1).alias("held_out"), "text")
    return language_id.identify(rows, _language_model(docs)).drop("text")


@_query
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op5_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_documents(_table(spark, sf_dir, "documents"))


@_query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(_table(spark, sf_dir, "documents"), _remainder(5) == 1)


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


@_query
def op1_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_table(spark, sf_dir, "documents"))


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return chat_format.digests(chat_format.read_back(chat_format.build_forest(rows)))


ORACLES["op2_chat_format"] = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), written AS (
  SELECT *, length(replace(text, '\', '\\'))
           + 2 * len(regexp_extract_all(text, '<\||\[/?INST\]|</?s>|<</?SYS>>')) AS body_chars,
         length(replace(role, '\', '\\'))
           + 2 * len(regexp_extract_all(role, '<\||\[/?INST\]|</?s>|<</?SYS>>'))
           + len(regexp_extract_all(role, '\n')) AS role_chars
  FROM every
), sized AS (
  SELECT *, 12 + role_chars + 1 + body_chars + 10 + 1 AS chars,
         12 + role_chars + 1 + body_chars + 10 + 1 + strlen(role) - length(role) + strlen(text) - length(text) AS bytes
  FROM written
), placed AS (
  SELECT *, coalesce(sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(sum(bytes) AS BIGINT) AS n_positions, CAST(sum(before) AS BIGINT) AS attended
FROM placed GROUP BY conv_id
"""


ORACLES["op1_near_lines"] = r"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no,
         lower(trim(regexp_replace(parts[n], '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM raw)
), every AS (
  SELECT * FROM numbered WHERE line <> ''
), firsts AS (
  SELECT line, min(row(doc_id, line_no)) AS place FROM every GROUP BY line
), cut AS (
  SELECT line, place, i, left(line, i - 1) || substr(line, i + 1) AS v
  FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS i FROM firsts)
), pairs AS (
  SELECT a.line, b.place FROM cut a JOIN cut b USING (v, i) WHERE a.line <> b.line
  UNION ALL SELECT a.line, b.place FROM cut a JOIN firsts b ON a.v = b.line
  UNION ALL SELECT b.line, a.place FROM cut a JOIN firsts b ON a.v = b.line
), near AS (
  SELECT line, min(place) AS place FROM pairs GROUP BY line
), told AS (
  SELECT e.doc_id, e.line_no, f.place AS own,
         CASE WHEN n.place < f.place THEN n.place WHEN f.place < row(e.doc_id, e.line_no) THEN f.place END AS first
  FROM every e JOIN firsts f USING (line) LEFT JOIN near n USING (line)
)
SELECT doc_id, line_no, first IS NULL AS kept, first[1] AS first_doc_id, first[2] AS first_line_no,
       CASE WHEN first IS NOT NULL THEN CAST(first <> own AS INTEGER) END AS edits
FROM told
"""

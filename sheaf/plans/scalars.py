"""Queries that apply small rules to the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions import values as V
from sheaf.plans.registry import query, table


@query("label_codes", """
SELECT p_partkey, regexp_extract(trim(p_brand), '^([A-Za-z0-9/]+)', 1) AS code, len(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''))) AS parts FROM part
""")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.label_code(F.col("p_brand")).alias("code"), F.size(V.split_list(F.replace("p_name", F.lit(" "), F.lit(",")))).cast("long").alias("parts"))


@query("tolerant_numbers", r"""
WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '-' || event_id ELSE ' ' || event_id || ' ' END AS s FROM events)
SELECT event_id, CASE WHEN regexp_full_match(s, '\s*[+-]?\d+\s*') THEN greatest(CAST(trim(s) AS BIGINT), 0) ELSE 0 END AS n FROM v
""")
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, own = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(key == 0, F.get_json_object("props", "$.k")).when(key == 1, F.format_string("%.17g", "value")).when(key == 2, F.concat(F.lit("-"), own)).otherwise(F.concat(F.lit(" "), own, F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", V.whole_number(text).alias("n"))


@query("resource_pressure", """
WITH s AS (SELECT s_suppkey, s_acctbal / 100 AS pct, CAST(trunc(s_acctbal * 1000000) AS BIGINT) AS mem, CAST(trunc(s_acctbal * 3000000) AS BIGINT) AS disk FROM supplier)
SELECT s_suppkey, array_to_string(list_filter([CASE WHEN pct >= 90 THEN 'memory_percent' END, CASE WHEN mem < 4294967296 THEN 'memory_available' END,
  CASE WHEN pct >= 95 THEN 'disk_percent' END, CASE WHEN disk < 10737418240 THEN 'disk_free' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s
""")
def resource_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, amount = F.col("s_acctbal") / 100, lambda k: (F.col("s_acctbal") * k).cast("long")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(V.pressure(share, amount(1000000), share, amount(3000000)), ",").alias("reasons"))


@query("exit_codes", """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN -9 WHEN 2 THEN 137 WHEN 3 THEN 143 ELSE event_id % 200 END AS code FROM events)
SELECT event_id, CASE WHEN code < 0 OR code IN (137, 143) THEN 'process_killed' WHEN code <> 0 THEN 'process_failed' END AS category,
       least(0.5 * pow(2, least(event_id % 9, 5)), 30) AS wait FROM e
""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id") % 5
    code = F.when(key == 0, 0).when(key == 1, -9).when(key == 2, 137).when(key == 3, 143).otherwise(F.col("event_id") % 200)
    return table(spark, sf_dir, "events").select("event_id", V.exit_category(code).alias("category"), V.backoff(F.col("event_id") % 9 + 1, 0.5).alias("wait"))


@query("document_status", """
SELECT conv_id, CASE WHEN bool_or(role = 'system' AND length(text) > 150) THEN 'failed' WHEN bool_or(role IN ('user', 'assistant') AND turn < 6) THEN 'success' ELSE 'failed_no_content' END AS status
FROM conversations GROUP BY 1
""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page statuses by role: a long system turn is an error, later turns are blank pages."""
    system = F.col("role") == "system"
    status = F.when(system & (F.length("text") > 150), "error").when(F.col("role").isin("user", "assistant") & (F.col("turn") < 6), "success").otherwise("skipped_blank")
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("page"), status.alias("status"))).alias("p"))
    return pages.select("conv_id", V.document_status(F.col("p")).alias("status"))


@query("blank_pages", """
WITH g AS (SELECT vec_id, [CASE WHEN vec_id % 3 = 0 THEN 250 + (x > 0)::INT ELSE floor((x + 1) * 127) END FOR x IN CAST(embedding AS DOUBLE[])] AS grey FROM embeddings),
s AS (SELECT vec_id, list_avg(grey) AS m, len(list_filter(grey, lambda x: x > 240)) / len(grey) AS light, list_var_pop(grey) AS v FROM g)
SELECT vec_id, light > 0.99 AND v < 0.001 * 255 * 255 AS blank FROM s
""")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 3 == 0, 250 + F.when(x > 0, 1).otherwise(0)).otherwise(F.floor((x.cast("double") + 1) * 127)).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.is_blank_page(grey).alias("blank"))


@query("layout_line_parse", r"""
WITH t AS (SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 3, '0') || ' 010 ' || lpad(CAST(p_size + 100 AS VARCHAR), 3, '0') || ' 999' || 'title' || chr(10) || 'noise ' || p_name AS s FROM part)
SELECT p_partkey, CAST(regexp_extract(s, '^(\d{3}) (\d{3}) (\d{3}) (\d{3})([a-z_]+)', 1) AS INTEGER) AS x1,
       CAST(regexp_extract(s, '^(\d{3}) (\d{3}) (\d{3}) (\d{3})([a-z_]+)', 3) AS INTEGER) AS x2, regexp_extract(s, '^(\d{3}) (\d{3}) (\d{3}) (\d{3})([a-z_]+)', 5) AS kind FROM t
""")
def layout_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    text = F.concat(three(F.col("p_size")), F.lit(" 010 "), three(F.col("p_size") + 100), F.lit(" 999title\nnoise "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(V.layout_lines(text)).alias("b")).select("p_partkey", "b.x1", "b.x2", "b.kind")


@query("human_sizes", """
SELECT p_partkey, CAST(floor(p_size::BIGINT * CASE p_partkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END) AS BIGINT) AS bytes FROM part
""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    unit = F.when(key == 0, " KB").when(key == 1, "MB").when(key == 2, "").otherwise(" b")
    return table(spark, sf_dir, "part").select("p_partkey", T.human_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("suffix_filter", """
SELECT page_id, url, ends_with(lower(url), '.html') OR ends_with(lower(url), '.tar.gz') OR ends_with(lower(url), '/') AS wanted FROM pages
""")
def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", (V.has_suffix(F.col("url"), "html", ".tar.gz") | F.endswith("url", F.lit("/"))).alias("wanted"))


@query("url_redaction", r"""
SELECT page_id, regexp_replace('db' || '://user:pw' || page_id || '@' || url, '://([^:/@]+):[^@]+@', '://\1:***@') AS shown FROM pages
""")
def url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", V.without_password(F.concat(F.lit("db://user:pw"), F.col("page_id").cast("string"), F.lit("@"), "url")).alias("shown"))


@query("api_error_classes", """
SELECT event_type AS type, event_id % 3 AS code, CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'timeout' WHEN event_id % 3 = 1 THEN 'rate_limit' WHEN event_id % 3 = 2 THEN 'http_status'
       WHEN event_type = 'view' THEN 'model_output' ELSE 'unexpected' END AS category, count(*) AS n FROM events GROUP BY ALL
""")
def api_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id") % 3
    kind = F.when((F.col("event_type") == "error") & (key == 0), "TimeoutError").otherwise("ValueError")
    status = F.when(key == 1, 429).when(key == 2, 500)
    category = T.api_error_category(kind, status, F.when(F.col("event_type") == "view", "Empty response from server").otherwise("odd"), F.lit("api_call"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type"), key.alias("code"), category.alias("category")).agg(F.count("event_id").alias("n"))


@query("text_cleaning", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace('\documentclass{a} \usepackage[x]{y}' || text, '(?i)\\documentclass\{[^}]+\}', '', 'g'), '(?i)\\usepackage\[[^\]]*\]\{[^}]+\}', '', 'g') AS cleaned FROM conversations
""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_preamble(F.concat(F.lit("\\documentclass{a} \\usepackage[x]{y}"), "text")).alias("cleaned"))

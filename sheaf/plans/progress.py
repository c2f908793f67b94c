"""Queries over progress, freezing, samples and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.plans.control import job_events
from sheaf.plans.registry import query, table


@query("worker_progress", """
SELECT user_id AS job_id, count(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'view') AS pages,
       count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) % 7) FILTER (event_type IN ('purchase', 'error')) AS ended_files,
       count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) % 7) FILTER (event_type = 'error') AS failed_files,
       round(arg_max(value, (ts, event_id)) FILTER (event_type = 'click'), 6) AS gauge
FROM events GROUP BY 1
""")
def worker_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages and files by how they ended, and the latest gauge that was sent."""
    kind = F.col("event_type")
    latest = F.max_by("value", F.when(kind == "click", F.struct("ts", "event_id")))
    gauges = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.round(latest, 6).alias("gauge"), F.count_if(kind == "click").alias("sent"))
    seen = job_events(spark, sf_dir).groupBy("job_id").agg(
        F.count_distinct(F.when(kind == "page_done", F.col("page_no"))).alias("pages"),
        F.count_distinct(F.when(kind.isin("file_done", "file_failed"), F.col("file_path"))).alias("ended_files"),
        F.count_distinct(F.when(kind == "file_failed", F.col("file_path"))).alias("failed_files"),
    )
    return seen.join(gauges, "job_id").select("job_id", "pages", "ended_files", "failed_files", F.when(F.col("sent") > 0, F.col("gauge")).alias("gauge"))


@query("freeze_report", """
WITH u AS (
  SELECT o_custkey AS job, count(*) AS units, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS active, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS failed,
         CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1
)
SELECT job, units, active, failed, bytes, active = 0 AND failed = 0 AS may_freeze,
       CASE WHEN active > 0 THEN 'scanning' WHEN failed > 0 THEN 'failed' ELSE 'ready' END AS status FROM u
""")
def freeze_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest freezes when no unit is active and none has failed."""
    status = F.col("o_orderstatus")
    units = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(
        F.count("o_orderkey").alias("units"), F.count_if(status == "O").alias("active"), F.count_if(status == "P").alias("failed"), F.sum(F.col("o_totalprice").cast("long")).alias("bytes")
    )
    told = F.when(F.col("active") > 0, "scanning").when(F.col("failed") > 0, "failed").otherwise("ready")
    return units.withColumns({"may_freeze": (F.col("active") == 0) & (F.col("failed") == 0), "status": told})


@query("recent_samples", """
WITH last AS (
  SELECT user_id AS job_id, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS file, max(ROW(ts, event_id)) AS newest FROM events WHERE event_type = 'error' GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY newest DESC) AS n FROM last)
SELECT job_id, string_agg('f' || file, ',' ORDER BY n) AS files FROM r WHERE n <= 3 GROUP BY 1
""")
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failed files of each job, each file once, three at most."""
    failed = job_events(spark, sf_dir).where("event_type = 'file_failed'")
    last = failed.groupBy("job_id", "file_path").agg(F.max(F.struct("ts", "id")).alias("at"))
    ranked = last.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("at")))).where("n <= 3")
    return ranked.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("n", "file_path"))).alias("s")).select("job_id", F.array_join(F.col("s.file_path"), ",").alias("files"))


@query("input_totals", """
WITH m AS (SELECT l_orderkey AS job, l_linenumber AS manifest, CAST(sum(l_quantity) AS BIGINT) AS files FROM lineitem GROUP BY 1, 2),
     s AS (SELECT l_orderkey AS job, CAST(count(*) AS BIGINT) AS shard_files FROM lineitem GROUP BY 1)
SELECT job, greatest(max(files), max(shard_files)) AS static_input, CAST(sum(files) AS BIGINT) AS remaining_input FROM m JOIN s USING (job) GROUP BY 1
""")
def input_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest manifest against all shard files, and, another number, the sum over manifests."""
    manifests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("files"), F.count("l_orderkey").alias("n"))
    return manifests.groupBy("job").agg(F.greatest(F.max("files"), F.sum("n")).alias("static_input"), F.sum("files").alias("remaining_input"))


@query("trace_merge", """
WITH p AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 7 = 0 THEN role || '_unavailable' END AS reason FROM conversations)
SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn, role) AS stages, bool_or(reason IS NOT NULL) AS fallback_used,
       CASE WHEN count(DISTINCT reason) = 1 THEN max(reason) WHEN count(DISTINCT reason) > 1 THEN 'multiple' END AS reason
FROM p GROUP BY 1
""")
def trace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of all pages in order; one reason of fallbacks, or that there were several."""
    reason = F.when(F.length("text") % 7 == 0, F.concat("role", F.lit("_unavailable")))
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("s"), reason.alias("reason"))
    merged = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.bool_or(F.col("reason").isNotNull()).alias("fallback_used"), F.count_distinct("reason").alias("n"), F.max("reason").alias("one"))
    stages = F.array_join(F.transform("s", lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ",")
    return merged.select("conv_id", stages.alias("stages"), "fallback_used", F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, "multiple").alias("reason"))


@query("page_summary", """
SELECT conv_id, count(*) AS pages, CAST(count_if(role IN ('user', 'assistant')) AS BIGINT) AS completed, CAST(count_if(role = 'system') AS BIGINT) AS failed,
       array_to_string(list_sort(list(DISTINCT role)), ',') AS statuses FROM conversations GROUP BY 1
""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("turn").alias("pages"), F.count_if(role.isin("user", "assistant")).alias("completed"), F.count_if(role == "system").alias("failed"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("statuses")
    )


@query("schema_drift", """
WITH known AS (SELECT n_nationkey AS version, md5(n_name) AS checksum FROM nation WHERE n_nationkey % 5 <> 4),
     applied AS (SELECT n_nationkey AS version, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 7 = 0 THEN 'other' ELSE md5(n_name) END AS checksum FROM nation WHERE n_nationkey % 4 <> 3)
SELECT coalesce(k.version, a.version) AS version, CASE WHEN a.version IS NULL THEN 'missing' WHEN k.version IS NULL THEN 'unexpected' WHEN a.checksum IS NULL THEN 'unverified'
       WHEN a.checksum <> k.checksum THEN 'mismatch' ELSE 'ok' END AS verdict FROM known k FULL JOIN applied a ON a.version = k.version
""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied versions against known ones."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.md5(F.col("n_name").cast("binary")).alias("sum"))
    known = nation.where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("k"), F.col("sum").alias("ks"))
    sums = F.when(F.col("n_nationkey") % 6 == 0, F.lit(None)).when(F.col("n_nationkey") % 7 == 0, "other").otherwise(F.col("sum"))
    applied = nation.where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("a"), sums.alias("sa"))
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("k").isNull(), "unexpected").when(F.col("sa").isNull(), "unverified").when(F.col("sa") != F.col("ks"), "mismatch").otherwise("ok")
    return known.join(applied, F.col("k") == F.col("a"), "full").select(F.coalesce("k", "a").alias("version"), verdict.alias("verdict"))


@query("box_rendering", """
SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN NULL WHEN role = 'user' THEN '# ' || split_part(text, '.', 1) WHEN contains(text, '=') THEN '$$' || chr(10) || text || chr(10) || '$$' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS rendered
FROM conversations WHERE role <> 'system' GROUP BY 1
""")
def box_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in reading order: page furniture goes, titles, formulas and text get their own form."""
    form = F.when(F.col("role") == "user", F.concat(F.lit("# "), F.split_part("text", F.lit("."), F.lit(1)))).when(F.contains("text", F.lit("=")), F.concat(F.lit("$$\n"), "text", F.lit("\n$$"))).otherwise(F.col("text"))
    blocks = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", form.alias("b")))).alias("s"))
    return blocks.select("conv_id", F.array_join(F.col("s.b"), "\n\n").alias("rendered"))


@query("monitor_summary", """
SELECT event_type AS kind, count(*) AS calls, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(max(value), 6) AS peak FROM events GROUP BY 1
""")
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count("value").alias("calls"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("peak")
    )


@query("datasource_lookup", """
SELECT page_id, CAST(coalesce(n_nationkey, -1) AS BIGINT) AS datasource FROM pages LEFT JOIN nation ON n_nationkey = page_id % 40
""")
def datasource_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of the source of each page, with a default."""
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 40).alias("key"))
    return pages.join(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("key") == F.col("n_nationkey"), "left").select("page_id", F.coalesce(F.col("n_nationkey").cast("long"), F.lit(-1)).alias("datasource"))

"""Queries over what workers and jobs report: alerts, preflight, recent errors and files, artifacts, cells, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import cells as C
from sheaf.functions import text_udf
from sheaf.functions import values as V
from sheaf.operators import alerts, artifacts, policy, recent
from sheaf.plans.registry import query, table

_ALERT_RULES = " UNION ALL ".join(
    f"SELECT nation, '{code}' AS code, {count} AS count FROM f" for code, count in {
        "migration_drift": "CASE WHEN nation % 6 = 0 THEN 0 ELSE greatest(nation % 4, CASE WHEN nation % 5 = 0 THEN 1 ELSE 0 END) END",
        "stale_worker_heartbeat": "stale", "worker_resource_pressure": "constrained", "event_spool_backlog": "events", "log_spool_backlog": "logs", "shard_update_spool_backlog": "updates",
        "worker_capacity_exhausted": "CASE WHEN nation % 3 <> 0 AND slots = 0 THEN queue ELSE 0 END", "stale_shard_lease": "CASE WHEN nation % 3 <> 0 THEN leases ELSE 0 END",
        "throughput_samples_insufficient": "CASE WHEN nation % 3 <> 0 AND queue > 0 AND nation % 2 = 0 THEN greatest(10 - nation, 1) ELSE 0 END",
        "stage_failures": "CASE WHEN nation % 4 <> 1 THEN errors ELSE 0 END", "fallback_usage": "CASE WHEN nation % 4 <> 1 THEN views ELSE 0 END",
        "manifest_integrity_attention": "CASE WHEN nation % 4 <> 1 THEN nation % 3 ELSE 0 END", "artifact_records_missing": "CASE WHEN nation % 4 <> 1 THEN nation % 2 ELSE 0 END",
        "output_audit_not_reported": "CASE WHEN nation % 4 <> 1 AND nation % 2 + errors > 0 AND nation % 7 <> 0 THEN 1 ELSE 0 END",
    }.items()
)
_ALERT_NAMES = ", ".join(f"('{c}', '{s}', '{r}')" for c, s, r in alerts.ALERTS)


@query("operational_alerts", f"""
WITH w AS (
  SELECT s_nationkey AS nation, count(*) FILTER (s_acctbal < 0) AS stale, count(*) FILTER (s_acctbal > 9000) AS constrained,
         CAST(sum(s_suppkey % 3 + s_suppkey % 2) FILTER (s_suppkey % 5 <> 0) AS BIGINT) AS events, CAST(sum(greatest(s_suppkey % 4 - 2, 0)) AS BIGINT) AS logs, CAST(sum(s_suppkey % 2) AS BIGINT) AS updates
  FROM supplier GROUP BY 1
), c AS (
  SELECT c_nationkey AS nation, count(*) FILTER (c_mktsegment = 'BUILDING') AS queue, count(*) FILTER (c_acctbal > 9500) AS slots, count(*) FILTER (c_acctbal < -900) AS leases FROM customer GROUP BY 1
), e AS (
  SELECT user_id % 25 AS nation, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1
), f AS (
  SELECT n_nationkey AS nation, coalesce(stale, 0) AS stale, coalesce(constrained, 0) AS constrained, coalesce(w.events, 0) AS events, coalesce(logs, 0) AS logs, coalesce(updates, 0) AS updates,
         coalesce(queue, 0) AS queue, coalesce(slots, 0) AS slots, coalesce(leases, 0) AS leases, coalesce(errors, 0) AS errors, coalesce(views, 0) AS views
  FROM nation LEFT JOIN w ON w.nation = n_nationkey LEFT JOIN c ON c.nation = n_nationkey LEFT JOIN e ON e.nation = n_nationkey
)
SELECT r.nation, r.code, a.severity, a.recommendation, CAST(r.count AS BIGINT) AS count
FROM ({_ALERT_RULES}) r JOIN (VALUES {_ALERT_NAMES}) a(code, severity, recommendation) ON a.code = r.code WHERE r.count > 0
""")
def operational_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each nation, whose suppliers stand in for workers, customers for queued work and users for audited jobs."""
    key = F.col("s_suppkey")
    workers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") < 0).alias("stale"), (F.col("s_acctbal") > 9000).alias("constrained"),
        F.when(key % 5 != 0, F.array(key % 3, key % 2, F.lit(None), F.lit(-1)).cast("array<long>")).alias("events"), F.array(key % 4 - 2).cast("array<long>").alias("logs"), F.array(key % 2).cast("array<long>").alias("updates"),
    )
    queued = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("queue"), F.count_if(F.col("c_acctbal") > 9500).alias("slots"), F.count_if(F.col("c_acctbal") < -900).alias("stale_leases")
    )
    audited = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("nation")).agg(
        F.count_if(F.col("event_type") == "error").alias("stage_failures"), F.count_if(F.col("event_type") == "view").alias("fallbacks")
    )
    nation = F.col("nation")
    facts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    for part in (alerts.worker_facts(workers, ["nation"]), queued, audited):
        facts = facts.join(part, "nation", "left")
    facts = facts.withColumns({
        "migrated": F.lit(True), "current": F.when(nation % 5 != 0, True).when(nation % 6 == 0, True), "drifted": F.when(nation % 6 != 0, nation % 4),
        "capacity_known": nation % 3 != 0, "sample_pages": nation, "confidence": F.when(nation % 2 == 0, "none").otherwise("high"), "audit_known": nation % 4 != 1,
        "manifests_open": nation % 3, "declared": F.lit(None).cast("long"), "missing": nation % 2, "completed": F.col("stage_failures"), "output_reported": nation % 7 == 0,
    })
    return alerts.active_alerts(facts, ["nation"])


@query("job_preflight", """
WITH j AS (
  SELECT c_custkey AS job_id, c_nationkey AS n, c_custkey % 3 <> 0 AS rooted, CASE WHEN c_custkey % 7 = 0 THEN [c_custkey % 50, c_custkey % 11] END AS allowed,
         CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END AS profile, c_custkey % 2 = 0 AS has_key, CASE WHEN c_custkey % 10 = 1 THEN 'model_profile_certification_missing' END AS gate FROM customer
), w AS (
  SELECT s_suppkey AS id, s_nationkey AS n, s_suppkey % 6 AS version, s_acctbal > 9000 AS constrained, s_suppkey % 8 = 0 AS events, s_suppkey % 13 = 0 AS updates, s_suppkey % 3 AS status, s_acctbal > 1000 AS writes_input, s_suppkey % 40 <> 7 AS writes_output,
         s_suppkey % 10 <> 3 AND s_acctbal > -500 AS usable FROM supplier
), e AS (
  SELECT job_id, count(*) AS eligible, count(*) FILTER (status > 0) AS ready, bool_or(NOT writes_output) AS no_output, bool_or(rooted AND NOT writes_input) AS no_manifest, count(DISTINCT version) > 1 AS mixed,
         bool_or(constrained) AS constrained, bool_or(events) AS events, bool_or(updates) AS updates
  FROM j JOIN w ON w.n = j.n AND usable AND (allowed IS NULL OR list_contains(allowed, id)) GROUP BY 1
), i AS (
  SELECT j.job_id, CASE WHEN allowed IS NULL THEN (SELECT count(*) FROM w) ELSE (SELECT count(*) FROM w WHERE list_contains(allowed, id)) END AS total_workers, coalesce(eligible, 0) AS eligible_workers, coalesce(ready, 0) AS ready_workers,
    list_filter(['control_api_auth_disabled:warning', CASE WHEN e.job_id IS NULL THEN 'no_eligible_workers:error' END, CASE WHEN no_output THEN 'output_path_not_writable:error' END, CASE WHEN no_manifest THEN 'manifest_root_not_writable:error' END,
      CASE WHEN mixed THEN 'mixed_worker_versions:warning' END, CASE WHEN constrained THEN 'resource_constrained_workers:warning' END, CASE WHEN events THEN 'worker_event_spool_backlog:warning' END, CASE WHEN updates THEN 'worker_pending_shard_update_backlog:warning' END,
      CASE WHEN profile > 5 THEN 'unknown_model_profile:error' WHEN profile % 2 = 0 AND NOT (profile = 4 OR has_key) THEN 'model_profile_missing_api_key:error' WHEN profile >= 4 THEN 'model_profile_saved_api_key:warning' END,
      CASE WHEN profile IS NOT NULL THEN gate || ':error' END], lambda x: x IS NOT NULL) AS issues
  FROM j LEFT JOIN e USING (job_id)
)
SELECT job_id, len(list_filter(issues, lambda x: ends_with(x, ':error'))) = 0 AS ok, total_workers, eligible_workers, ready_workers, array_to_string(issues, ',') AS issues FROM i
""")
def job_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand in for jobs and suppliers for workers; those of a nation share a folder."""
    key, server = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    folder = lambda c: F.concat(F.lit("/share/n"), text(F.col(c)))
    jobs = table(spark, sf_dir, "customer").select(
        key.alias("job_id"), F.concat(folder("c_nationkey"), F.lit("/in/"), text(key)).alias("input_dir"), F.lit("/out/all/").alias("output_dir"), F.when(key % 3 != 0, folder("c_nationkey")).alias("manifest_root"),
        F.when(key % 7 == 0, F.array(key % 50, key % 11)).alias("allowed"), F.when(key % 4 != 0, key % 9).alias("profile_id"), (key % 2 == 0).alias("has_key"), F.when(key % 10 == 1, "model_profile_certification_missing").alias("gate"),
    )
    entry = lambda path, writable: F.struct(path.alias("path"), F.lit(True).alias("readable"), writable.alias("writable"))
    workers = table(spark, sf_dir, "supplier").select(
        server.alias("server_id"), F.when(server % 3 == 0, "busy").when(server % 3 == 1, "online").otherwise("idle").alias("status"), (server % 10 == 3).alias("stale"), (F.col("s_acctbal") <= -500).alias("archived"),
        text(server % 6).alias("version"), (F.col("s_acctbal") > 9000).alias("constrained"), F.when(server % 8 == 0, 3).alias("event_backlog"), F.when(server % 13 == 0, 1).otherwise(0).alias("update_backlog"),
        F.array(entry(F.concat(folder("s_nationkey"), F.lit("/")), F.col("s_acctbal") > 1000), entry(F.lit("/out"), server % 40 != 7)).alias("paths"),
    )
    profiles = spark.range(6).select(F.col("id").alias("profile_id"), (F.col("id") % 2 == 0).alias("requires_key"), (F.col("id") == 4).alias("has_key"), (F.col("id") >= 4).alias("key_saved"))
    return policy.preflight(jobs, workers, profiles, has_token=False)


@query("recent_errors", """
WITH e AS (SELECT user_id AS job_id, event_id, ts, event_type, CAST(event_id AS VARCHAR) AS file_path, event_type || user_id % 2 AS failure_category, props AS error FROM events WHERE event_type = 'error' AND user_id % 3 <> 0),
s AS (
  SELECT user_id AS job_id, CASE WHEN event_type = 'view' THEN 'event_sample' ELSE 'failed_file_sample' END AS source, event_id, event_type, CAST(event_id AS VARCHAR) AS file_path, event_type || user_id % 2 AS failure_category, props AS error
  FROM events WHERE event_id % 4 = 0 AND event_type IN ('view', 'error')
), a AS (
  SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k, 'job_event' AS source, event_type, file_path, failure_category, error, count(*) OVER (PARTITION BY job_id) AS total FROM e
  UNION ALL
  SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY source, event_id), source, event_type, file_path, failure_category, error, count(*) OVER (PARTITION BY job_id) FROM s WHERE job_id NOT IN (SELECT job_id FROM e)
)
SELECT job_id, CAST(k AS INTEGER) AS k, source, event_type, file_path, failure_category, error, total, total > 4 AS has_more FROM a WHERE k BETWEEN 2 AND 4
""")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand in for jobs; every third has lost its events and shows samples."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("created_at"), "event_type", F.col("event_id").cast("string").alias("file_path"),
        F.concat("event_type", (F.col("user_id") % 2).cast("string")).alias("failure_category"), F.col("props").alias("error"),
    )
    source = F.when(F.col("event_type") == "view", "event_sample").otherwise("failed_file_sample")
    samples = events.where((F.col("event_id") % 4 == 0) & F.col("event_type").isin("view", "error")).withColumnsRenamed({"event_id": "pos"}).withColumn("source", source).drop("created_at")
    return recent.recent_errors(events.where((F.col("event_type") == "error") & (F.col("job_id") % 3 != 0)), samples, limit=3, offset=1)


@query("recent_files", """
WITH f AS (SELECT l_orderkey AS job_id, l_partkey * 10 + l_linenumber AS id, 'f' || l_partkey % 90 AS path, l_shipdate AS ts FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT l_orderkey AS job_id, 'f' || l_suppkey % 90 AS path, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
u AS (
  SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC NULLS LAST, id DESC) AS r, path, 'file' AS source FROM f
  UNION ALL SELECT job_id, 1000 + row_number() OVER (PARTITION BY job_id ORDER BY pos, path), path, 'sample' FROM p ANTI JOIN f USING (job_id, path)
), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY r) AS k FROM u)
SELECT job_id, CAST(k AS INTEGER) AS k, path AS file_path, 'failed' AS status, source FROM r WHERE k <= 2
""")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    path = lambda c: F.concat(F.lit("f"), (F.col(c) % 90).cast("string")).alias("file_path")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "success").otherwise("pending")
    files = lines.select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("file_id"), path("l_partkey"), status.alias("status"), F.col("l_shipdate").alias("updated_at"))
    samples = lines.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("pos"), path("l_suppkey"))
    return recent.recent_files(files, samples, "failed", 2)


_LISTED = '["a.json", {"path": "x/../c.jsonl"}, "../out.md", "a.json", {"kind": "none"}]'


@query("artifact_reports", f"""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 9 AS c FROM orders),
f AS (
  SELECT l_orderkey AS id, bool_or(l_linenumber = 1 AND l_quantity >= 10) AS md, bool_or(l_linenumber = 1) AS md_there, bool_or(l_linenumber = 2) AS a_there, bool_or(l_linenumber = 2 AND l_discount > 0.03) AS a,
         bool_or(l_linenumber = 3) AS c_there, bool_or(l_linenumber = 3 AND l_tax > 0.03) AS j, bool_or(l_linenumber = 3 AND l_returnflag = 'A') AS dir FROM lineitem GROUP BY 1
), t AS (
  SELECT o.id, c, md_there AS m1, md AS m2, a_there AS a1, a AS a2, c_there AS c1, j AS c2, dir FROM o JOIN f USING (id)
  UNION ALL SELECT o.id, c, false, false, false, false, false, false, false FROM o ANTI JOIN f USING (id)
), r AS (
  SELECT id, c, CASE c WHEN 0 THEN NULL WHEN 1 THEN 'invalid' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'success' END AS status,
    CASE c WHEN 0 THEN ['/o/' || id || '/.ocr_status.json'] ELSE list_filter([CASE WHEN c > 5 AND NOT m1 THEN '/o/' || id || '/' || id || '.md' END, CASE WHEN c > 6 AND NOT a1 THEN 'a.json' END, CASE WHEN c > 6 AND NOT c1 THEN 'x/../c.jsonl' END], lambda x: x IS NOT NULL) END AS missing,
    CASE c WHEN 1 THEN ['/o/' || id || '/.ocr_status.json:invalid_sidecar'] ELSE list_filter([CASE WHEN c > 5 AND m1 AND NOT m2 THEN '/o/' || id || '/' || id || '.md:empty_file' END, CASE WHEN c > 6 AND a1 AND NOT a2 THEN 'a.json:invalid_json' END,
      CASE WHEN c > 6 AND c1 AND dir THEN 'x/../c.jsonl:not_file' WHEN c > 6 AND c1 AND NOT c2 THEN 'x/../c.jsonl:invalid_jsonl' END, CASE WHEN c > 6 THEN '../out.md:outside_output_dir' END], lambda x: x IS NOT NULL) END AS invalid FROM t
), g AS (SELECT *, CASE c WHEN 0 THEN 'artifact_missing' WHEN 1 THEN 'sidecar_invalid' WHEN 2 THEN 'artifact_incomplete' WHEN 3 THEN 'timeout' WHEN 4 THEN 'page_failure' WHEN 5 THEN 'page_failure' ELSE CASE WHEN len(missing) > 0 THEN 'artifact_missing' WHEN len(invalid) > 0 THEN 'artifact_invalid' END END AS failure_category FROM r)
SELECT id AS out_id, failure_category IS NULL AS ok, status, failure_category, array_to_string(missing, ',') AS missing, array_to_string(invalid, ',') AS invalid FROM g
""")
def artifact_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for outputs, their lines for the files in the output's folder."""
    key = F.col("o_orderkey")
    folder = lambda c: F.concat(F.lit("/o/"), F.col(c).cast("string"))
    forms = {
        1: '{"status": ', 2: '{"status": "failed"}', 3: '{"status": "failed", "failure_category": "timeout"}', 4: '{"status": "success", "failed_pages": "2"}',
        5: '{"status": "success", "failed_pages": 0, "page_status_counts": {"error": 1}}', 6: '{"status": "success", "failed_pages": null}',
    }
    sidecar = F.when(key % 9 > 6, f'{{"status": "success", "artifacts": {_LISTED}}}')
    for k, form in forms.items():
        sidecar = sidecar.when(key % 9 == k, form)
    outputs = table(spark, sf_dir, "orders").select(key.alias("out_id"), folder("o_orderkey").alias("folder"), F.concat(folder("o_orderkey"), F.lit("/"), key.cast("string"), F.lit(".md")).alias("markdown"), sidecar.alias("sidecar"))
    n = F.col("l_linenumber")
    name = F.when(n == 1, F.concat(F.col("l_orderkey").cast("string"), F.lit(".md"))).when(n == 2, "a.json").when(n == 3, "c.jsonl")
    content = F.when(n == 2, F.when(F.col("l_discount") > 0.03, '{"a": [1]}').otherwise('{"a": [1}')).when(n == 3, F.when(F.col("l_tax") > 0.03, '{"a": 1}\n \n[2]').otherwise('{"a": 1}\nx'))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(
        F.concat(folder("l_orderkey"), F.lit("/"), name).alias("path"), (~((n == 3) & (F.col("l_returnflag") == "A"))).alias("is_file"), F.when((n == 1) & (F.col("l_quantity") < 10), 0).otherwise(5).alias("size"), content.alias("content")
    )
    files = lines.groupBy("path").agg(F.min("is_file").alias("is_file"), F.max("size").alias("size"), F.min("content").alias("content"))  # lines may repeat
    found = artifacts.artifact_report(outputs, files)
    return found.withColumns({"missing": F.array_join("missing", ","), "invalid": F.array_join("invalid", ",")})


@query("page_cells", r"""
WITH c AS (
  SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Page-header' WHEN 2 THEN 'Footnote' WHEN 3 THEN 'Title' ELSE 'Page-footer' END AS category FROM conversations
)
SELECT conv_id, count(*) AS cells, coalesce(sum(length(text)) FILTER (NOT (turn % 5 IN (0, 2) AND regexp_matches(text, '(?i)the|[.]de'))), 0)::BIGINT AS without_keywords,
       count(*) FILTER (category NOT IN ('Page-header', 'Footnote')) AS with_footers, count(*) FILTER (category NOT IN ('Page-header', 'Page-footer')) AS plain FROM c GROUP BY 1
""")
def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand in for cells: keywords and page furniture."""
    of = F.col("turn") % 5
    category = F.when(of == 0, "Text").when(of == 1, "Page-header").when(of == 2, "Footnote").when(of == 3, "Title").otherwise("Page-footer")
    cells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(category.alias("category"), "text")).alias("cells"))
    chars = F.aggregate(C.without_keywords(F.col("cells"), ["THE", ".de"]), F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(F.length(c["text"]), F.lit(0)))
    n = lambda c: F.size(c).cast("long")
    return cells.select(
        "conv_id", n("cells").alias("cells"), chars.alias("without_keywords"), n(C.without_furniture(F.col("cells"), keep_footer=True, skip_footnote=True)).alias("with_footers"), n(C.without_furniture(F.col("cells"))).alias("plain")
    )


@query("line_ends", r"""
SELECT conv_id, turn, md5('a' || chr(10) || text || chr(10) || '$x\n$ \$' || chr(10) || CASE WHEN turn % 2 = 0 THEN '\(\n' || replace(text, '$', '') || '\)' || chr(10) ELSE '$$\r$\n' END) AS text
FROM (SELECT conv_id, turn, replace(replace(text, '$', ''), chr(92), '') AS text FROM conversations)
""")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written-out line ends around every turn, inside and outside of mathematics."""
    bare = F.regexp_replace("text", r"[$\\]", "")
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(r"\(\n"), bare, F.lit(r"\)\r"))).otherwise(F.lit(r"$$\r$\n"))
    whole = F.concat(F.lit(r"a\n"), bare, F.lit(r"\r\n$x\n$ \$\n"), tail)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text_udf.with_line_ends(whole).cast("binary")).alias("text"))


@query("integrity_issues", """
WITH r AS (
  SELECT o_orderkey AS job_id, o_orderkey % 3 AS bad_units, o_orderkey % 2 AS bad_shards, o_orderkey % 5 = 0 AS ok, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS units, o_orderkey % 7 <> 0 AS unit_rows, o_orderkey % 11 <> 0 AS unit_bytes,
         o_orderkey % 13 <> 0 AS there, o_orderkey % 17 <> 0 AS error_free, o_orderkey % 19 <> 0 AS meta_there, o_orderkey % 23 <> 0 AS meta_rows, o_orderkey % 29 <> 0 AS meta_bytes, o_orderkey % 6 <> 0 AS meta, o_orderkey % 8 <> 0 AS meta_total, o_orderkey % 31 <> 0 AS shard_rows FROM orders
)
SELECT job_id, CAST(bad_units + bad_shards + CASE WHEN ok THEN 0 WHEN units > 0 THEN CAST(NOT (unit_rows AND unit_bytes) AS INTEGER)
  ELSE CAST(NOT (there AND error_free) AS INTEGER) + CAST(NOT meta_there OR (meta AND (NOT meta_rows OR (meta_total AND NOT meta_bytes))) AS INTEGER) END + CASE WHEN NOT ok AND NOT shard_rows THEN 1 ELSE 0 END AS BIGINT) AS issues FROM r
""")
def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    reports = table(spark, sf_dir, "orders").select(
        key.alias("job_id"), (key % 3).alias("bad_scan_units"), (key % 2).alias("bad_shards"), (key % 5 == 0).alias("ok"), F.when(key % 4 == 0, 2).alias("scan_units"), (key % 7 != 0).alias("scan_unit_rows_match"), (key % 11 != 0).alias("scan_unit_bytes_match"),
        (key % 13 != 0).alias("manifest_exists"), F.lit(True).alias("manifest_rows_match"), F.lit(True).alias("manifest_bytes_match"), F.when(key % 17 == 0, "unreadable").alias("manifest_error"),
        F.when(key % 19 == 0, False).alias("meta_exists"), F.lit(None).cast("string").alias("meta_error"), F.when(key % 6 != 0, "/m.json").alias("meta_path"), (key % 23 != 0).alias("meta_rows_match"), F.when(key % 8 != 0, 5).alias("meta_bytes"), (key % 29 != 0).alias("meta_bytes_match"),
        (key % 31 != 0).alias("shard_rows_match"),
    )
    return reports.select("job_id", policy.integrity_issues().alias("issues"))


@query("safe_names", r"""
WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'v1.' || p_size || '.0' WHEN 1 THEN '10.0.' || p_size || '.1' WHEN 2 THEN 'my-Token-' || p_size WHEN 3 THEN 'host.lan' WHEN 4 THEN replace(p_type, ' ', '-') ELSE p_type END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 4 THEN regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_.@+-]{0,254}') WHEN 5 THEN NOT contains(name, ' ') ELSE false END AS safe FROM n
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of versions, addresses, secrets, hosts and plain words as revisions."""
    of, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    plain = F.when(of == 4, F.replace("p_type", F.lit(" "), F.lit("-"))).otherwise(F.col("p_type"))
    name = F.when(of == 0, F.concat(F.lit("v1."), size, F.lit(".0"))).when(of == 1, F.concat(F.lit("10.0."), size, F.lit(".1"))).when(of == 2, F.concat(F.lit("my-Token-"), size)).when(of == 3, "host.lan").otherwise(plain)
    return table(spark, sf_dir, "part").select("p_partkey", V.safe_identifier(name).alias("safe"))

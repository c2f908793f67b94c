"""Queries over jobs, shards, servers and events; the provided tables stand in for the control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators import events as E
from sheaf.operators import jobs as J
from sheaf.operators.prefix import running_totals
from sheaf.plans.registry import query, table

#: Queries never read the clock.
AS_OF = "2024-01-15 12:00:00"
KINDS = {"signup": "file_started", "view": "page_done", "purchase": "file_done", "error": "file_failed", "click": "job_heartbeat"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: the user is the job, the key in props the page, the event type the kind."""
    raw, kind = table(spark, sf_dir, "events"), F.lit(None)
    for name, of in KINDS.items():
        kind = F.when(F.col("event_type") == name, of).otherwise(kind)
    page = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    status = F.when((F.col("event_type") == "purchase") & (F.col("value") < 20), "skipped").when(F.col("value") > 80, "success_fallback_image")
    return raw.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), "ts", kind.alias("event_type"), page.alias("page_no"),
        F.concat(F.lit("f"), (page % 7).cast("string")).alias("file_path"), status.alias("status"),
        F.when(F.col("event_type") == "signup", page).alias("total_pages"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), page.cast("string"))).alias("error"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("o"), page.cast("string"))).alias("output_path"),
    )


_EVENTS = """
WITH ev AS (
  SELECT user_id AS job_id, event_id AS id, ts,
         CASE event_type WHEN 'signup' THEN 'file_started' WHEN 'view' THEN 'page_done' WHEN 'purchase' THEN 'file_done'
                         WHEN 'error' THEN 'file_failed' WHEN 'click' THEN 'job_heartbeat' END AS event_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS page_no,
         'f' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS VARCHAR) AS file_path,
         CASE WHEN event_type = 'purchase' AND value < 20 THEN 'skipped' WHEN value > 80 THEN 'success_fallback_image' END AS status,
         CASE WHEN event_type = 'signup' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS total_pages,
         CASE WHEN event_type = 'error' THEN 'e' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS error,
         CASE WHEN event_type = 'purchase' THEN 'o' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS output_path
  FROM events
), seen AS (
  SELECT * FROM ev WHERE file_path IS NOT NULL AND event_type IN ('file_started', 'file_done', 'file_failed')
  QUALIFY row_number() OVER (PARTITION BY job_id, event_type, file_path ORDER BY ts, id) = 1
  UNION ALL
  SELECT * FROM ev WHERE file_path IS NOT NULL AND event_type = 'page_done' AND page_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id, event_type, file_path, page_no ORDER BY ts, id) = 1
  UNION ALL
  SELECT * FROM ev WHERE NOT coalesce(file_path IS NOT NULL AND (event_type IN ('file_started', 'file_done', 'file_failed')
                                      OR (event_type = 'page_done' AND page_no IS NOT NULL)), false)
)
"""


@query("metrics_stage_outcomes", """
WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 2880 MINUTE AND ts <= TIMESTAMP '2024-01-15 12:00:00'),
     newest AS (SELECT * FROM w ORDER BY ts DESC, event_id DESC LIMIT 400)
SELECT CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE 'other' END AS stage,
       CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 THEN 'failed' ELSE 'success' END AS outcome,
       count(*) AS n, (SELECT count(*) > 400 FROM w) AS truncated
FROM newest GROUP BY ALL
""")
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by stage among the newest events of a closed window."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id").where(E.in_closed_window(F.col("ts"), AS_OF, 2880))
    page = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    outcome = F.when(page % 5 == 0, "failed").otherwise("success")
    return E.newest_then_count(rows, 400, J.bounded_label(F.col("event_type"), ("view", "click", "error")).alias("stage"), outcome.alias("outcome"))


@query("metrics_failure_events", """
SELECT c_mktsegment AS engine, CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE 'other' END AS category, count(*) AS n
FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL
""")
def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("engine"), J.bounded_label(F.col("event_type"), ("error", "purchase"), "none").alias("category")).agg(F.count("event_id").alias("n"))


@query("metrics_shard_queue", """
SELECT o_orderpriority AS engine, l_returnflag AS status, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('O', 'P') AND l_linestatus = 'O' GROUP BY ALL
""")
def shard_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimable work by engine and status, for jobs that may still run."""
    jobs = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderpriority")
    open_work = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_returnflag")
    joined = open_work.join(jobs, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("engine"), F.col("l_returnflag").alias("status")).agg(F.count("l_orderkey").alias("n"))


@query("workers_slots_by_status", """
SELECT CASE WHEN s_acctbal < 0 THEN 'offline' ELSE 'online' END AS status, count(*) AS servers,
       CAST(sum(greatest(coalesce(CAST(trunc(s_acctbal) AS BIGINT), 0), 0)) AS BIGINT) AS slots
FROM supplier GROUP BY ALL
""")
def slots_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_acctbal") < 0, "offline").otherwise("online")
    return rows.groupBy(status.alias("status")).agg(F.count("s_suppkey").alias("servers"), F.sum(J.clamped(F.col("s_acctbal").cast("long"))).alias("slots"))


_SUMMARY = """
WITH files AS (
  SELECT l_orderkey AS k, count(*) AS total, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS done,
         CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failed, CAST(count_if(l_returnflag = 'N' AND l_linestatus = 'F') AS BIGINT) AS skipped,
         CAST(sum(l_quantity) AS BIGINT) AS pages
  FROM lineitem GROUP BY 1
), shards AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS files, max(n) AS largest, CAST(count_if(bad > 0) AS BIGINT) AS failed_shards, count(*) AS shards
  FROM (SELECT l_orderkey AS k, l_linenumber % 3 AS shard, count(*) AS n, count_if(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1, 2) GROUP BY 1
), ev AS (
  SELECT user_id AS k, CAST(count_if(event_type = 'purchase') AS BIGINT) AS done, CAST(count_if(event_type = 'error') AS BIGINT) AS failed,
         min(ts) AS first_event_at, max(ts) FILTER (event_type = 'click') AS last_heartbeat_at
  FROM events GROUP BY 1
), merged AS (
  SELECT o_orderkey AS job_id, o_orderstatus,
         greatest(coalesce(f.total, 0), coalesce(s.files, 0)) AS total_files,
         greatest(coalesce(f.done, 0), coalesce(e.done, 0)) AS done, greatest(coalesce(f.failed, 0), coalesce(e.failed, 0)) AS failed,
         coalesce(f.skipped, 0) AS skipped, coalesce(f.pages, 0) AS pages, coalesce(s.failed_shards, 0) AS failed_shards,
         coalesce(s.shards, 0) AS shards, e.first_event_at, e.last_heartbeat_at
  FROM orders LEFT JOIN files f ON f.k = o_orderkey LEFT JOIN shards s ON s.k = o_orderkey LEFT JOIN ev e ON e.k = o_orderkey
), c1 AS (
  SELECT *, CASE WHEN total_files > 0 THEN least(failed, total_files) ELSE failed END AS failed_files FROM merged
), c2 AS (
  SELECT *, CASE WHEN total_files > 0 THEN least(skipped, greatest(total_files - failed_files, 0)) ELSE skipped END AS skipped_files FROM c1
)
SELECT job_id, total_files, failed_files, skipped_files,
       CASE WHEN total_files > 0 THEN least(done, greatest(total_files - failed_files - skipped_files, 0)) ELSE done END AS completed_files,
       pages, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN failed_shards > 0 THEN 'failed' WHEN shards > 0 THEN 'running'
                   WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS stage,
       first_event_at, last_heartbeat_at
FROM c2
"""


@query("job_summary", _SUMMARY)
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs at once: each fact table is summed by job, then joined; three kinds of evidence merge by maximum."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity")
    bad = F.col("l_returnflag") == "R"
    by_shard = lines.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("shard")).agg(
        F.count("l_orderkey").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(bad).alias("failed"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("skipped"), F.sum("l_quantity").alias("pages"),
    )
    files = by_shard.groupBy("k").agg(
        F.sum("n").alias("total"), F.sum("done").alias("f_done"), F.sum("failed").alias("f_failed"), F.sum("skipped").alias("f_skipped"),
        F.sum("pages").cast("long").alias("pages"), F.count_if(F.col("failed") > 0).alias("failed_shards"), F.count("shard").alias("shards"),
    )
    kind = F.col("event_type")
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(
        F.count_if(kind == "purchase").alias("e_done"), F.count_if(kind == "error").alias("e_failed"),
        F.min("ts").alias("first_event_at"), F.max(F.when(kind == "click", F.col("ts"))).alias("last_heartbeat_at"),
    )
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    joined = jobs.join(files, "k", "left").join(seen, "k", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    merged = joined.withColumns({"done": F.greatest(n("f_done"), n("e_done")), "failed": F.greatest(n("f_failed"), n("e_failed")), "all": n("total")})
    failed, skipped, completed = J.reconciled(F.col("all"), F.col("done"), F.col("failed"), n("f_skipped"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    zero = F.lit(0)
    return merged.select(
        F.col("k").alias("job_id"), F.col("all").alias("total_files"), failed.alias("failed_files"), skipped.alias("skipped_files"),
        completed.alias("completed_files"), n("pages").alias("pages"),
        J.lifecycle(status, n("failed_shards"), zero, zero, n("shards"), zero).alias("stage"), "first_event_at", "last_heartbeat_at",
    )


@query("job_progress_eta", """
WITH p AS (
  SELECT l_orderkey AS job_id, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS BIGINT) AS done, CAST(sum(l_quantity) AS BIGINT) AS total,
         epoch(max(l_shipdate)) - epoch(min(l_shipdate)) AS seconds
  FROM lineitem GROUP BY 1
), r AS (SELECT *, CASE WHEN seconds > 0 AND done > 0 THEN round_even(done / seconds, 4) END AS pages_per_second FROM p)
SELECT job_id, pages_per_second,
       CASE WHEN pages_per_second > 0 AND total - done > 0 THEN CAST(trunc((total - done) / pages_per_second) AS BIGINT) END AS eta_seconds
FROM r
""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    seconds = F.unix_timestamp(F.max("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.min("l_shipdate").cast("timestamp"))
    sums = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).cast("long").alias("done"), F.sum("l_quantity").cast("long").alias("total"), seconds.cast("double").alias("seconds")
    )
    rate, eta = J.rate_and_eta(F.col("done"), F.col("seconds"), F.col("total") - F.col("done"))
    return sums.select("job_id", rate.alias("pages_per_second"), eta.alias("eta_seconds"))


@query("event_dedup_counters", _EVENTS + """
SELECT s.job_id, CAST(count_if(event_type = 'file_started') AS BIGINT) AS started_files,
       CAST(coalesce(sum(total_pages) FILTER (event_type = 'file_started'), 0) AS BIGINT) AS total_pages,
       CAST(count_if(event_type = 'page_done') AS BIGINT) AS completed_pages,
       CAST(count_if(event_type = 'page_done' AND status = 'success_fallback_image') AS BIGINT) AS degraded_pages,
       CAST(count_if(event_type = 'file_done' AND status IS DISTINCT FROM 'skipped') AS BIGINT) AS completed_files,
       CAST(count_if(event_type = 'file_done' AND status = 'skipped') AS BIGINT) AS skipped_files,
       CAST(count_if(event_type = 'file_failed') AS BIGINT) AS failed_files,
       min(a.first_event_at) AS first_event_at, min(a.last_event_at) AS last_event_at
FROM seen s JOIN (SELECT job_id, min(ts) AS first_event_at, max(ts) AS last_event_at FROM ev GROUP BY 1) a USING (job_id) GROUP BY s.job_id
""")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counters(job_events(spark, sf_dir))


@query("file_state_fold", _EVENTS + """
, st AS (
  SELECT *, CASE event_type WHEN 'file_started' THEN 'running' WHEN 'page_done' THEN 'running'
                            WHEN 'file_done' THEN coalesce(status, 'success') WHEN 'file_failed' THEN 'failed' END AS new_status
  FROM ev WHERE file_path IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, file_path ORDER BY (new_status IS NULL), ts DESC, id DESC) AS rs,
         row_number() OVER (PARTITION BY job_id, file_path ORDER BY (event_type NOT IN ('file_started', 'file_done', 'file_failed')), ts DESC, id DESC) AS re,
         row_number() OVER (PARTITION BY job_id, file_path ORDER BY (event_type <> 'file_started' OR total_pages IS NULL), ts DESC, id DESC) AS rt,
         row_number() OVER (PARTITION BY job_id, file_path ORDER BY (event_type <> 'file_done'), ts DESC, id DESC) AS ro
  FROM st
)
SELECT job_id, file_path, coalesce(max(new_status) FILTER (rs = 1), 'pending') AS status,
       max(error) FILTER (re = 1 AND event_type = 'file_failed') AS error,
       max(total_pages) FILTER (rt = 1 AND event_type = 'file_started') AS total_pages,
       count(DISTINCT page_no) FILTER (event_type = 'page_done') AS done_pages,
       max(output_path) FILTER (ro = 1 AND event_type = 'file_done') AS output_path
FROM r GROUP BY 1, 2
""")
def file_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.file_states(job_events(spark, sf_dir))


_CLASS = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"


def _retained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), "ts", "event_type")
    return rows, F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)


@query("recent_failures_topn", f"""
SELECT user_id AS job_id, event_id AS id, event_type, CAST(row_number() OVER w AS INTEGER) AS rank
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_CLASS}, ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 3
""")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, priority = _retained(spark, sf_dir)
    return E.recent(rows, "job_id", priority, 3).select("job_id", "id", "event_type", "rank")


@query("retention_prune", f"""
SELECT user_id AS job_id, event_id AS id FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY {_CLASS}, ts DESC, event_id DESC) QUALIFY row_number() OVER w > 5
""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, priority = _retained(spark, sf_dir)
    return E.surplus(rows, "job_id", priority, 5).select("job_id", "id")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_size", F.lit(1).cast("long").alias("one"))
    rank = running_totals(parts, ["p_name", "p_partkey"], {"before": "one"})
    return rank.select("p_partkey", "p_size", J.shard_index(F.col("before") + 1, 300).alias("shard_index"))


_NUMBERED = "SELECT p_partkey, p_size, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 300 + 1 AS BIGINT) AS shard_index FROM part"


@query("shard_numbering", f"SELECT p_partkey, shard_index FROM ({_NUMBERED})")
def shard_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of exactly so many files in path order; ranks come from distributed prefix sums, not from one task."""
    return _numbered(spark, sf_dir).select("p_partkey", "shard_index")


@query("shard_sizes", f"SELECT shard_index, count(*) AS file_count, CAST(sum(p_size) AS BIGINT) AS total_bytes FROM ({_NUMBERED}) GROUP BY 1")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).groupBy("shard_index").agg(F.count("p_partkey").alias("file_count"), F.sum("p_size").alias("total_bytes"))


@query("lease_sweep", """
WITH w AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'stale' WHEN 'N' THEN 'running' ELSE 'succeeded' END AS status,
         CAST(epoch(l_shipdate) - epoch(TIMESTAMP '1996-06-01 00:00:00') AS BIGINT) AS remaining, o_orderstatus = 'P' AS stopping, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
SELECT status, CASE WHEN status = 'stale' THEN 'stale' WHEN status = 'succeeded' THEN 'none' WHEN remaining <= 0 THEN 'expired'
                    WHEN remaining <= 30 THEN 'expiring' ELSE 'healthy' END AS lease,
       CASE WHEN status = 'running' AND remaining <= 0 THEN
              CASE WHEN stopping THEN 'stopped' WHEN l_linenumber >= 3 THEN 'failed' ELSE 'stale' END ELSE status END AS after,
       count(*) AS n
FROM w GROUP BY ALL
""")
def lease_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease states and what the expiry sweep makes of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("stopping"))
    status = F.when(F.col("l_returnflag") == "A", "stale").when(F.col("l_returnflag") == "N", "running").otherwise("succeeded")
    left = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.lit("1996-06-01 00:00:00").cast("timestamp"))
    work = lines.join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"status": status, "left": left})
    after = J.swept(F.col("status"), F.col("left") <= 0, F.col("l_linenumber"), F.lit(3), F.col("stopping"))
    return work.groupBy("status", J.lease_state(F.col("status"), F.col("left")).alias("lease"), after.alias("after")).agg(F.count("l_orderkey").alias("n"))


@query("claim_assignment", """
WITH q AS (
  SELECT l_suppkey AS server, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_linenumber, l_orderkey, l_partkey, l_quantity, l_extendedprice) AS slot
  FROM lineitem WHERE l_returnflag IN ('A', 'N')
)
SELECT server, CAST(slot AS INTEGER) AS slot, l_orderkey, l_linenumber FROM q JOIN supplier ON s_suppkey = server
WHERE slot <= greatest(CAST(trunc(s_acctbal / 1000) AS BIGINT), 0)
""")
def claim_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery work first, then by shard index, so many pieces as the server has slots."""
    work = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N")).select(
        F.col("l_suppkey").alias("server"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("priority"), F.col("l_linenumber").alias("shard_index"),
        F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("id"),
    )
    servers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server"), J.clamped((F.col("s_acctbal") / 1000).cast("long")).alias("slots"))
    return J.claims(work, servers).select("server", "slot", "id.l_orderkey", F.col("shard_index").alias("l_linenumber"))


@query("attempt_fencing", """
WITH r AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1 AS accepted,
         l_quantity
  FROM lineitem
)
SELECT l_orderkey, accepted, count(*) AS attempts, CAST(sum(l_quantity) AS BIGINT) AS pages FROM r GROUP BY ALL
""")
def attempt_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("shard"), F.col("l_shipdate").alias("attempt_number"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("id")
    )
    return J.current_attempts(rows).groupBy("l_orderkey", "accepted").agg(F.count("l_orderkey").alias("attempts"), F.sum("l_quantity").cast("long").alias("pages"))


@query("job_finalize", """
WITH s AS (
  SELECT l_orderkey AS job_id, CAST(count_if(l_linestatus = 'O') AS BIGINT) AS open_shards,
         CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failed_shards FROM lineitem GROUP BY 1
), f AS (
  SELECT l_orderkey AS job_id, l_partkey AS failed_pick FROM lineitem WHERE l_returnflag = 'R'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber, l_partkey) = 1
)
SELECT s.job_id, CASE WHEN open_shards > 0 THEN 'running' WHEN failed_shards > 0 THEN 'failed' ELSE 'succeeded' END AS status,
       CASE WHEN open_shards = 0 THEN failed_pick END AS failed_pick
FROM s LEFT JOIN f USING (job_id)
""")
def job_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job ends when no shard is open; of its failed shards the one that ended last explains it."""
    bad = F.col("l_returnflag") == "R"
    newest = F.struct(F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), (-F.col("l_linenumber")).alias("n"), (-F.col("l_partkey")).alias("p"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(bad).alias("failed"), F.max_by("l_partkey", F.when(bad, newest)).alias("pick")
    )
    status = F.when(F.col("open") > 0, "running").when(F.col("failed") > 0, "failed").otherwise("succeeded")
    return sums.select("job_id", status.alias("status"), F.when((F.col("open") == 0) & (F.col("failed") > 0), F.col("pick")).alias("failed_pick"))


@query("capacity_report", """
WITH w AS (
  SELECT count(DISTINCT (user_id, json_extract_string(props, '$.k'))) AS pages FROM events
  WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1440 MINUTE AND ts <= TIMESTAMP '2024-01-15 12:00:00'
), running AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
slots AS (
  SELECT count(*) AS servers, CAST(count_if(s_acctbal > 0) AS BIGINT) AS ready,
         CAST(sum(CASE WHEN s_acctbal > 0 THEN greatest(CAST(trunc(s_acctbal) AS BIGINT) - coalesce(n, 0), 0) ELSE 0 END) AS BIGINT) AS available
  FROM supplier LEFT JOIN running ON s = s_suppkey
), rest AS (SELECT CAST(sum(l_quantity) AS BIGINT) AS remaining FROM lineitem WHERE l_linestatus = 'O')
SELECT servers, ready, available, pages, remaining,
       CASE WHEN pages > 0 THEN CAST(round_even(remaining / (pages / 24.0), 0) AS BIGINT) END AS eta_hours,
       CASE WHEN pages = 0 THEN 'none' WHEN pages < 10 THEN 'low' WHEN pages < 100 THEN 'medium' ELSE 'high' END AS confidence
FROM slots, w, rest
""")
def capacity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free slots, distinct pages of the window, remaining pages and the time they take; single values come as scalars."""
    views = table(spark, sf_dir, "events").where((F.col("event_type") == "view") & E.in_closed_window(F.col("ts"), AS_OF, 1440))
    pages = views.agg(F.count_distinct("user_id", F.get_json_object("props", "$.k"))).scalar()
    lines = table(spark, sf_dir, "lineitem")
    remaining = lines.where("l_linestatus = 'O'").agg(F.sum("l_quantity").cast("long")).scalar()
    running = lines.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_suppkey").alias("n"))
    free = F.greatest(F.col("s_acctbal").cast("long") - F.coalesce("n", F.lit(0)), F.lit(0))
    slots = table(spark, sf_dir, "supplier").join(running, "s_suppkey", "left").agg(
        F.count("s_suppkey").alias("servers"), F.count_if(F.col("s_acctbal") > 0).alias("ready"), F.sum(F.when(F.col("s_acctbal") > 0, free).otherwise(0)).alias("available")
    )
    report = slots.withColumns({"pages": pages, "remaining": remaining})
    eta = F.when(F.col("pages") > 0, F.bround(F.col("remaining") / (F.col("pages") / 24.0), 0).cast("long"))
    confidence = F.when(F.col("pages") == 0, "none").when(F.col("pages") < 10, "low").when(F.col("pages") < 100, "medium").otherwise("high")
    return report.withColumns({"eta_hours": eta, "confidence": confidence})


@query("audit_report", """
SELECT l_linestatus AS status, l_returnflag AS failure_category, count(*) AS attempts, CAST(count_if(l_tax = 0) AS BIGINT) AS missing_artifacts,
       CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS flagged
FROM lineitem GROUP BY ALL
""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("failure_category"))
    return rows.agg(F.count("l_orderkey").alias("attempts"), F.count_if(F.col("l_tax") == 0).alias("missing_artifacts"), F.count_if(F.col("l_discount") > 0.05).alias("flagged"))


@query("manifest_integrity", """
WITH s AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS shards, count(*) AS n FROM lineitem GROUP BY 1),
     j AS (SELECT p_partkey, s.k, s.shards, s.n FROM part FULL JOIN s ON s.k = p_partkey)
SELECT count(p_partkey) AS manifest_files, count(k) AS shard_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS shard_rows,
       CAST(count_if(shards > 1) AS BIGINT) AS overlapping, CAST(count_if(p_partkey IS NULL) AS BIGINT) AS unknown,
       CAST(count_if(k IS NULL) AS BIGINT) AS unassigned FROM j
""")
def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the manifest against files of the shards: overlaps, unknown ones, ones in no shard."""
    shards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_distinct("l_suppkey").alias("shards"), F.count("l_partkey").alias("n"))
    both = table(spark, sf_dir, "part").select("p_partkey").join(shards, F.col("p_partkey") == F.col("k"), "full")
    return both.agg(
        F.count("p_partkey").alias("manifest_files"), F.count("k").alias("shard_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("shard_rows"), F.count_if(F.col("shards") > 1).alias("overlapping"),
        F.count_if(F.col("p_partkey").isNull()).alias("unknown"), F.count_if(F.col("k").isNull()).alias("unassigned"),
    )


#: Ids that are looked at together.
CLAIM_BLOCK = 1024


@query("claim_gaps", """
WITH c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
     ids AS (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS id)
SELECT i.id, coalesce(n, 0) AS claims FROM ids i LEFT JOIN c USING (id) WHERE coalesce(n, 0) <> 1
""")
def claim_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that were claimed twice or never. Ids meet in blocks of bounded size, so no id but an answer is made up."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("l_orderkey").alias("n"))
    held = counts.groupBy(F.floor(F.col("id") / CLAIM_BLOCK).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("n"))
    top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    last = top if top is not None else -1
    blocks = spark.range(0, last // CLAIM_BLOCK + 1).withColumnRenamed("id", "block").join(held, "block", "left")
    ids = F.sequence(F.col("block") * CLAIM_BLOCK, F.least((F.col("block") + 1) * CLAIM_BLOCK - 1, F.lit(last)))
    of = F.transform(ids, lambda i: F.struct(i.alias("id"), F.coalesce(F.try_element_at("n", i), F.lit(0)).cast("long").alias("claims")))
    return blocks.select(F.inline(F.filter(of, lambda x: x["claims"] != 1)))


@query("reconcile_full", """
SELECT coalesce(o_custkey, c_custkey) AS key, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'matched' END AS verdict,
       coalesce(n, 0) AS jobs
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN customer ON o_custkey = c_custkey
""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    both = actual.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "full")
    verdict = F.when(F.col("o_custkey").isNull(), "missing").when(F.col("c_custkey").isNull(), "unexpected").otherwise("matched")
    return both.select(F.coalesce("o_custkey", "c_custkey").alias("key"), verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("jobs"))


@query("queue_depth", """
SELECT l_suppkey AS server, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS running, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS pending,
       CAST(count_if(l_returnflag = 'A' AND l_shipdate <= TIMESTAMP '1996-06-01') AS BIGINT) AS expired, max(l_shipdate) AS last_lease,
       bool_or(l_linestatus = 'O') AS any_open
FROM lineitem GROUP BY 1
""")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running and waiting work and expired leases per server."""
    flag, late = F.col("l_returnflag"), F.col("l_shipdate") <= F.lit("1996-06-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("server")).agg(
        F.count_if(flag == "A").alias("running"), F.count_if(flag == "N").alias("pending"), F.count_if((flag == "A") & late).alias("expired"),
        F.max("l_shipdate").alias("last_lease"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open"),
    )


@query("jobs_page", """
SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS total, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') > 150 AS has_more
FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100
""")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of jobs with the total; the order has a unique last key."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderdate")
    total = rows.agg(F.count("o_orderkey")).scalar()
    page = rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return page.withColumns({"total": total, "has_more": total > 150})


@query("shard_filter", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_suppkey <= 20 AND l_linenumber >= 3 AND l_shipdate < TIMESTAMP '1996-06-01' - INTERVAL 30 DAY
""")
def shard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention states, worker, attempts and running time, as chained filters that reach the scan."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).where("l_suppkey <= 20").where("l_linenumber >= 3")
    late = F.lit("1996-06-01").cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return rows.where(F.col("l_shipdate") < late).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("attention_shards", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N')
ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_orderkey, l_partkey, l_suppkey, l_extendedprice LIMIT 50
""")
def attention_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R", "N"))
    return rows.orderBy(priority, "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").limit(50).select("l_orderkey", "l_linenumber", "l_partkey")


@query("regression_guard", """
SELECT p_brand AS variant, round(sum(l_quantity) / sum(l_extendedprice / 1000), 6) AS throughput, count(*) AS runs
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1
""")
def regression_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over duration of the runs that went well, by variant."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("variant")).agg(F.round(F.sum("l_quantity") / F.sum(F.col("l_extendedprice") / 1000), 6).alias("throughput"), F.count("l_orderkey").alias("runs"))


@query("p95_report", """
SELECT l_returnflag AS variant, count(*) AS runs, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity) AS DOUBLE) AS p95, round(avg(l_quantity), 4) AS mean
FROM lineitem GROUP BY 1
""")
def p95_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank 95th percentile by variant."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(
        F.count("l_orderkey").alias("runs"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").cast("double").alias("p95"), F.round(F.avg("l_quantity"), 4).alias("mean")
    )


@query("throughput_drift", """
WITH r AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total
  FROM events WHERE event_type <> 'error'
), q AS (
  SELECT user_id, total, avg(value) FILTER (n <= total // 4) AS early, avg(value) FILTER (n > total - total // 4) AS late FROM r WHERE total >= 4 GROUP BY 1, 2
)
SELECT user_id, total, round(early, 6) AS early, round(late, 6) AS late, round(greatest(0, (early - late) / early * 100), 4) AS drift_pct FROM q WHERE early > 0
""")
def throughput_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last quartile of each label's good cycles."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    by = Window.partitionBy("user_id")
    ranked = rows.select("user_id", "value", F.row_number().over(by.orderBy("ts", "event_id")).alias("n"), F.count("event_id").over(by).alias("total")).where("total >= 4")
    share = F.floor(F.col("total") / 4)
    quarters = ranked.groupBy("user_id", "total").agg(F.avg(F.when(F.col("n") <= share, F.col("value"))).alias("early"), F.avg(F.when(F.col("n") > F.col("total") - share, F.col("value"))).alias("late")).where("early > 0")
    drift = F.greatest(F.lit(0.0), (F.col("early") - F.col("late")) / F.col("early") * 100)
    return quarters.select("user_id", "total", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), F.round(drift, 4).alias("drift_pct"))


@query("resource_growth", """
WITH s AS (
  SELECT user_id, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value, count(*) AS samples FROM events GROUP BY 1
), d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, samples, round(first_value, 6) AS first_value, round(last_value, 6) AS last_value,
       (SELECT CAST(count_if(step > 0) AS BIGINT) FROM d WHERE d.user_id = s.user_id) AS rises FROM s
""")
def resource_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sample per label and how many steps go up."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "value", F.struct("ts", "event_id").alias("at"), (F.col("value") - F.lag("value").over(order)).alias("step"))
    return steps.groupBy("user_id").agg(
        F.count("value").alias("samples"), F.round(F.min_by("value", "at"), 6).alias("first_value"), F.round(F.max_by("value", "at"), 6).alias("last_value"), F.count_if(F.col("step") > 0).alias("rises")
    )


@query("restart_fencing", """
WITH reg AS (SELECT user_id AS server, max(ts) AS registered_at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT l_suppkey AS server, CASE WHEN registered_at IS NOT NULL AND l_returnflag = 'A' THEN 'stale' ELSE l_returnflag END AS status,
       CASE WHEN registered_at IS NOT NULL AND l_returnflag = 'A' THEN 'process_killed' END AS failure_category, count(*) AS n
FROM lineitem LEFT JOIN reg ON l_suppkey = server GROUP BY ALL
""")
def restart_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running work of a server that registered again is stale: its process was killed."""
    again = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("server")).distinct().withColumn("again", F.lit(True))
    work = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("server"), "l_returnflag").join(again, "server", "left")
    cut = F.coalesce("again", F.lit(False)) & (F.col("l_returnflag") == "A")
    return work.groupBy("server", F.when(cut, "stale").otherwise(F.col("l_returnflag")).alias("status"), F.when(cut, "process_killed").alias("failure_category")).agg(F.count("server").alias("n"))


@query("pending_updates", """
SELECT user_id AS shard, event_type AS status, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type IN ('purchase', 'error')) DESC, ts DESC, event_id DESC) = 1
""")
def pending_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest update per shard; a terminal one is never overwritten by another."""
    final = F.col("event_type").isin("purchase", "error")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("shard")).agg(F.max_by(F.struct("event_type", "event_id"), F.struct(final.alias("f"), "ts", "event_id")).alias("u"))
    return rows.select("shard", F.col("u.event_type").alias("status"), "u.event_id")


@query("version_histogram", """
SELECT n_regionkey AS job, count(DISTINCT s_acctbal > 0) AS versions,
       CASE WHEN count(s_suppkey) = 0 THEN 'unknown' WHEN count(DISTINCT s_acctbal > 0) = 1 THEN 'consistent' ELSE 'mixed' END AS verdict
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
""")
def version_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    kinds = F.count_distinct(F.col("s_acctbal") > 0)
    verdict = F.when(F.count("s_suppkey") == 0, "unknown").when(kinds == 1, "consistent").otherwise("mixed")
    return rows.groupBy(F.col("n_regionkey").alias("job")).agg(kinds.alias("versions"), verdict.alias("verdict"))


@query("metrics_exposition", """
SELECT 'orders_total{status="' || o_orderstatus || '",priority="' || replace(o_orderpriority, '"', '\\"') || '"} ' || CAST(count(*) AS VARCHAR) AS line
FROM orders GROUP BY o_orderstatus, o_orderpriority
""")
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""One text line per sample; labels escape backslash, quote and newline."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("o_orderkey").alias("n"))
    return counts.select(F.concat(F.lit('orders_total{status="'), safe("o_orderstatus"), F.lit('",priority="'), safe("o_orderpriority"), F.lit('"} '), F.col("n").cast("string")).alias("line"))

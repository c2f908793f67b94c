"""The newest errors and files of each job, filled up from stored samples where the detail rows are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The statuses that each kind of list shows.
FAILED = ("failed", "error")
MOST_FILES = 100


def recent_errors(events: DataFrame, samples: DataFrame, limit: int, offset: int = 0, category: str | None = None) -> DataFrame:
    """job_id, k (from 1), source, event_type, file_path, failure_category, error, total, has_more: one page per job.

    events: job_id, event_id, created_at, event_type, file_path, failure_category, error. samples: job_id, source
    (event_sample or failed_file_sample), pos and the same four last ones. Events count newest first, then by the larger
    id; a job without any takes its samples: those of events, then those of files, by pos. `category` filters both. A
    page is ranked behind a limit per task, so a job with very many events ships only its newest. Null times come last.
    """
    if category is not None:
        events, samples = events.where(F.col("failure_category") == category), samples.where(F.col("failure_category") == category)
    shown = ["event_type", "file_path", "failure_category", "error"]
    first_k, last_k = offset + 1, offset + limit

    def page(rows: DataFrame, *order: object) -> DataFrame:
        of_job = Window.partitionBy("job_id").orderBy(*order)
        return rows.withColumn("k", F.row_number().over(of_job)).where(F.col("k") <= last_k).where(F.col("k") >= first_k).select("job_id", "k", "source", *shown)

    totals = events.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    spare = samples.join(totals, "job_id", "left_anti")
    spare_totals = spare.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    told = page(events.withColumn("source", F.lit("job_event")), F.desc_nulls_last("created_at"), F.desc("event_id")).join(totals, "job_id")
    kept = page(spare, F.col("source") != "event_sample", "pos").join(spare_totals, "job_id")
    return told.unionByName(kept).withColumn("has_more", F.col("total") > last_k)


def recent_files(files: DataFrame, samples: DataFrame, kind: str, limit: int) -> DataFrame:
    """job_id, k (from 1), file_path, status, source (file or sample): at most `limit` (1 to 100) files of each job.

    files: job_id, file_id, file_path, status, updated_at. samples: job_id, pos, file_path. kind `failed` shows failed
    files, any other all that were worked on (completed, failed, skipped); newest first, then by the larger id. Failed
    files that don't fill the list are followed by samples of other paths, each path once, by pos; blank paths are none.
    """
    bound = max(1, min(limit, MOST_FILES))
    wanted = FAILED if kind == "failed" else (*FAILED, "success", "done", "completed", "skipped")
    shown = files.where(F.col("status").isin(*wanted))
    newest = Window.partitionBy("job_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("file_id"))
    top = shown.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= bound).select("job_id", "k", "file_path", "status", F.lit("file").alias("source"))
    if kind != "failed":
        return top
    counts = shown.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    paths = samples.where(F.col("file_path") != "").groupBy("job_id", "file_path").agg(F.min("pos").alias("pos"))
    other = paths.join(shown.select("job_id", "file_path").distinct(), ["job_id", "file_path"], "left_anti").join(counts, "job_id", "left")
    free = other.where(F.coalesce("n", F.lit(0)) < bound).withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy("pos", "file_path"))).where(F.col("r") <= bound)
    more = free.select("job_id", (F.coalesce("n", F.lit(0)) + F.col("r")).cast("int").alias("k"), "file_path", F.lit("failed").alias("status"), F.lit("sample").alias("source"))
    return top.unionByName(more.where(F.col("k") <= bound))

"""Event streams as batches: deduplication, counters, state folds, recent samples and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_EVENTS = ("file_started", "file_done", "file_failed")
PAGE_EVENT = "page_done"


def is_deduplicated(event_type: Column, file_path: Column, page_no: Column) -> Column:
    """Whether repeats of an event count once: file events with a file, page events with a file and a page."""
    has_file = file_path.isNotNull() & (file_path != "")
    return has_file & (event_type.isin(*FILE_EVENTS) | ((event_type == PAGE_EVENT) & page_no.isNotNull()))


def first_seen(events: DataFrame) -> DataFrame:
    """Drops later repeats of (job, type, file) or, for pages, of (job, type, file, page); other events all stay.

    Needs job_id, event_type, file_path, page_no, ts, id. Only events that can repeat are ranked.
    """
    once = is_deduplicated(F.col("event_type"), F.col("file_path"), F.col("page_no"))
    page = F.when(F.col("event_type") == PAGE_EVENT, F.col("page_no"))
    marked = events.withColumns({"_once": F.coalesce(once, F.lit(False)), "_page": page})
    order = Window.partitionBy("job_id", "event_type", "file_path", "_page").orderBy("ts", "id")
    ranked = marked.where("_once").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return ranked.unionByName(marked.where("NOT _once")).drop("_once", "_page")


def counters(events: DataFrame) -> DataFrame:
    """Per job: started, completed, failed and skipped files, pages, degraded pages, first and last event time."""
    spans = events.groupBy("job_id").agg(F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"))
    kind, status = F.col("event_type"), F.col("status")
    skipped = F.coalesce(status == "skipped", F.lit(False))
    counted = first_seen(events).groupBy("job_id").agg(
        F.count_if(kind == "file_started").alias("started_files"),
        F.coalesce(F.sum(F.when(kind == "file_started", F.col("total_pages"))), F.lit(0)).cast("long").alias("total_pages"),
        F.count_if(kind == PAGE_EVENT).alias("completed_pages"),
        F.count_if((kind == PAGE_EVENT) & (status == "success_fallback_image")).alias("degraded_pages"),
        F.count_if((kind == "file_done") & ~skipped).alias("completed_files"),
        F.count_if((kind == "file_done") & skipped).alias("skipped_files"),
        F.count_if(kind == "file_failed").alias("failed_files"),
    )
    return counted.join(spans, "job_id")


def file_states(events: DataFrame) -> DataFrame:
    """The last state of each (job, file): every field holds what the last event that writes this field wrote.

    A page after the end sets a file running again. done_pages counts distinct pages.
    """
    kind, at = F.col("event_type"), F.struct("ts", "id")
    failing = F.coalesce(F.col("status").isin("error", "failed"), F.lit(False))
    status = (
        F.when(kind == "file_started", "running")
        .when(kind == PAGE_EVENT, F.when(failing, "failed").otherwise("running"))
        .when(kind == "file_done", F.coalesce(F.nullif("status", F.lit("")), F.lit("success")))
        .when(kind == "file_failed", "failed")
    )
    writes_error = kind.isin(*FILE_EVENTS) | ((kind == PAGE_EVENT) & failing)
    error = F.when((kind == "file_failed") | failing, F.col("error"))
    last = lambda value, where: F.max_by(F.struct(value.alias("v")), F.when(where, at))["v"]
    known = events.where(F.col("file_path").isNotNull() & (F.col("file_path") != ""))
    return known.withColumns({"_status": status, "_error": error}).groupBy("job_id", "file_path").agg(
        F.coalesce(last(F.col("_status"), status.isNotNull()), F.lit("pending")).alias("status"),
        last(F.col("_error"), writes_error).alias("error"),
        last(F.col("total_pages"), (kind == "file_started") & F.col("total_pages").isNotNull()).alias("total_pages"),
        F.count_distinct(F.when(kind == PAGE_EVENT, F.col("page_no"))).alias("done_pages"),
        last(F.col("output_path"), kind == "file_done").alias("output_path"),
    )


def ranked_for_retention(rows: DataFrame, group: str, priority: Column) -> DataFrame:
    """Adds `rank` in each group: by priority class, then newest first, then largest id."""
    order = Window.partitionBy(group).orderBy(priority, F.desc("ts"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order))


def recent(rows: DataFrame, group: str, priority: Column, most: int) -> DataFrame:
    return ranked_for_retention(rows, group, priority).where(F.col("rank") <= most)


def surplus(rows: DataFrame, group: str, priority: Column, most: int) -> DataFrame:
    """What retention deletes: all that `recent` leaves."""
    return ranked_for_retention(rows, group, priority).where(F.col("rank") > most)


def in_closed_window(ts: Column, as_of: str, minutes: int) -> Column:
    """Both ends belong to the window."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (ts >= end - F.expr(f"INTERVAL {minutes} MINUTES")) & (ts <= end)


def newest_then_count(rows: DataFrame, most: int, *keys: Column) -> DataFrame:
    """Counts by keys among the newest `most` rows only, and whether more rows were there."""
    newest = rows.orderBy(F.desc("ts"), F.desc("id")).limit(most + 1)
    ranked = newest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id"))))  # most + 1 rows at most
    total = ranked.agg(F.count("id") > most).scalar()
    return ranked.where(F.col("_n") <= most).groupBy(*keys).agg(F.count("id").alias("n")).withColumn("truncated", total)

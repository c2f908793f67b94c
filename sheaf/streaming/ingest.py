"""Event streams: deduplicated counters, window counts, and good and bad records to two sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENVELOPE = "type string, job_id string, created_at timestamp, payload struct<file_path string, page_no int, status string, error string, total_pages int>"


def parsed(lines: DataFrame) -> DataFrame:
    """Event envelopes of a column `line`; `good` tells whether the line was one."""
    read = lines.select("line", F.from_json("line", ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"))
    good = F.col("e.type").isNotNull() & F.col("e.job_id").isNotNull()
    return read.select("line", "e.*", F.coalesce(good, F.lit(False)).alias("good"))


def deduplicated(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Drops repeats within the horizon; the batch form has none, see `operators.events.first_seen`.

    Events that can't repeat go round the stateful operator and leave nothing in its state.
    """
    payload = F.col("payload")
    repeats = payload["file_path"].isNotNull() & (F.col("type").isin("file_started", "file_done", "file_failed") | ((F.col("type") == "page_done") & payload["page_no"].isNotNull()))
    page = F.when(F.col("type") == "page_done", payload["page_no"].cast("string"))
    repeats = F.coalesce(repeats, F.lit(False))
    keyed = events.where(repeats).withColumn("_key", F.concat_ws("\x1f", "job_id", "type", payload["file_path"], page))
    once = keyed.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return once.unionByName(events.where(~repeats))


def running_counts(events: DataFrame) -> DataFrame:
    """Per job and type, how many events so far."""
    return events.groupBy("job_id", "type").agg(F.count("type").alias("n"))


def window_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per job in sliding hours, final once the watermark has passed."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", "60 minutes", "1 minute"), "job_id").agg(F.count("type").alias("n"))


def two_sinks(lines: DataFrame, good_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Appends good events and malformed lines to their own folders, each batch once.

    Batches overwrite their own subfolder, so a batch that is run again after a failure leaves no copies.
    """

    def write(batch: DataFrame, number: int) -> None:
        read = parsed(batch)
        read.where("good").drop("line", "good").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        read.where("NOT good").select("line").write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

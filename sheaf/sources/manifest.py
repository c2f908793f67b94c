"""Manifests, spools, sidecars and directories as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.text import valid_relative_path
from sheaf.operators.prefix import running_totals
from sheaf.sources.scratch import written


def scan_directory(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """path, size_bytes and mtime_ns of all files below the root, by path; contents are not read."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{either}").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).orderBy("path")


def read_manifest(spark: SparkSession, path: str, pdf_only: bool = True) -> DataFrame:
    """Manifest lines with their first violation in `problem` (null: a good row).

    line_no counts the lines of each file from 1, blank ones too. Types are strict: a number in quotes or with a point is
    none. A relative path that occurred before, by file name and line, is a duplicate; the first line keeps it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.lit(1).cast("long").alias("one"))
    lines = written(lines, "manifest")
    numbers = running_totals(lines.select("file", "at", "one"), ["at"], {"before": "one"}, "file").select("file", "at", (F.col("before") + 1).alias("line_no"))
    lines = lines.join(numbers, ["file", "at"])
    doc = F.try_parse_json("value")
    kind = lambda key: F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
    text = lambda key: F.try_variant_get(doc, f"$.{key}", "string")
    number = lambda key: F.try_variant_get(doc, f"$.{key}", "bigint")
    read = lines.where(F.trim("value") != "").select(
        "file", "line_no", doc.isNotNull().alias("is_json"), text("input_path").alias("input_path"), text("relative_path").alias("relative_path"),
        number("size_bytes").alias("size_bytes"), number("mtime_ns").alias("mtime_ns"),
        ((kind("input_path") == "STRING") & (kind("relative_path") == "STRING")).alias("texts"), ((kind("size_bytes") == "BIGINT") & (kind("mtime_ns") == "BIGINT")).alias("numbers"),
    )
    own = F.coalesce("relative_path", F.concat_ws(":", "file", F.col("line_no").cast("string")))  # lines without a path don't meet
    again = F.row_number().over(Window.partitionBy(F.col("relative_path").isNull(), own).orderBy("file", "line_no")) > 1
    good_path = valid_relative_path(F.col("relative_path")) if pdf_only else valid_relative_path(F.concat("relative_path", F.lit(".pdf")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(~F.col("is_json"), "bad_json").when(~yes(F.col("texts")) | (F.trim("input_path") == "") | (F.trim("relative_path") == ""), "bad_path_type")
        .when(~yes(F.col("numbers")) | (F.col("size_bytes") < 0) | (F.col("mtime_ns") < 0), "bad_number").when(~F.startswith("input_path", F.lit("/")), "input_path_not_absolute")
        .when(~good_path, "bad_relative_path").when(again, "duplicate_path")
    )
    return read.select("file", "line_no", "input_path", "relative_path", "size_bytes", "mtime_ns", problem.alias("problem"))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Spooled records: id, server_id, job_id, event and, for lines that are no JSON objects, raw_line."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    doc = F.try_parse_json("value")
    get = lambda key: F.try_variant_get(doc, f"$.{key}", "string")
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return raw.select(*(F.when(is_object, get(k)).alias(k) for k in ("id", "server_id", "job_id", "event")), F.when(~is_object, F.col("value")).alias("raw_line"))


def read_sidecars(spark: SparkSession, root: str, name: str = ".ocr_status.json") -> DataFrame:
    """One row per status sidecar below the root: path, status, document (variant; null: malformed)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    doc = F.try_parse_json(F.decode("content", "UTF-8"))
    return files.select("path", F.try_variant_get(doc, "$.status", "string").alias("status"), doc.alias("document"))


def decoded(content: Column) -> Column:
    """Text of bytes as UTF-8, else as GBK, else as Latin-1; only bytes that are no UTF-8 leave the JVM."""

    @F.pandas_udf("string")
    def other(values: pd.Series) -> pd.Series:
        return values.map(_other_text, na_action="ignore")

    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, other(F.when(utf8.isNull(), content)))


def _other_text(body: bytes) -> str:
    try:
        return bytes(body).decode("gbk")
    except UnicodeDecodeError:
        return bytes(body).decode("latin-1")


def write_shards(manifest: DataFrame, path: str, target: int) -> None:
    """One folder of JSON lines per shard (column shard_index) of rows that carry it; see the prefix-sum ranks."""
    if target <= 0:
        raise ValueError("a shard needs a positive number of files")
    manifest.repartition("shard_index").write.partitionBy("shard_index").json(path)


def assembled_markdown(pages: DataFrame, tag: bool = False) -> DataFrame:
    """doc, markdown: pages (doc, page_no, markdown) in page order, pages without number last."""
    body = F.concat(F.lit("<!-- page "), F.coalesce(F.col("page_no").cast("string"), F.lit("?")), F.lit(" -->\n"), "markdown") if tag else F.col("markdown")
    rows = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page_no", F.lit(2**31 - 1)).alias("n"), body.alias("b")))).alias("p"))
    return rows.select("doc", F.array_join(F.col("p.b"), "\n\n").alias("markdown"))


# The spool's files and the gauges that count them.
SPOOL_FILES = (("events.jsonl", "pending_event"), ("logs.jsonl", "pending_log"), ("events.failed.jsonl", "failed_event"), ("logs.failed.jsonl", "failed_log"))
DROPPED_FILES = (("events.dropped.json", "dropped_events"), ("logs.dropped.json", "dropped_logs"))


def spool_gauges(spark: SparkSession, root: str) -> DataFrame:
    """dir, lines that aren't blank and bytes of each spool file, and dropped counts, of each spool folder below the root.

    Files that aren't there count 0, as does a dropped count that is negative, no whole number or no JSON.
    """
    names = [n for n, _ in SPOOL_FILES + DROPPED_FILES]
    apart = lambda path: (F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(root).select(*apart(F.col("path")), "length")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(root).select(*apart(F.col("_metadata.file_path")), "value").where(F.col("name").isin(*names))
    dropped = F.try_variant_get(F.try_parse_json("value"), "$.dropped", "bigint")
    counts = lines.groupBy("dir", "name").agg(F.count_if(F.col("value").rlike(r"\S")).alias("n"), F.max(dropped).alias("dropped"))
    both = files.where(F.col("name").isin(*names)).join(counts.withColumn("dir", F.regexp_replace("dir", "^file:/+", "file:/")), ["dir", "name"], "left")
    of = lambda name, value: F.coalesce(F.max(F.when(F.col("name") == name, value)), F.lit(0)).cast("long")
    kept = [of(n, F.col("n")).alias(g + "s") for n, g in SPOOL_FILES] + [of(n, F.col("length")).alias(g + "_bytes") for n, g in SPOOL_FILES]
    return both.groupBy("dir").agg(*kept, *(of(n, F.greatest("dropped", F.lit(0))).alias(g) for n, g in DROPPED_FILES))


def pending_updates(spark: SparkSession, work_dir: str) -> DataFrame:
    """pending, failed: progress updates of shards that wait below a work folder, by file name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "shard-*").load(work_dir)
    at = lambda end: F.count_if(F.col("path").rlike(rf"/jobs/[^/]+/pending-shard-updates/shard-[^/]*\.json{end}$"))
    return files.agg(at("").alias("pending"), at(r"\.failed").alias("failed"))

"""Whether the files that a status record declares are there and sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.values import let


def resolved(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` segments; `..` at the root stays there."""
    none = F.expr("cast(array() AS array<string>)")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(F.split(path, "/", -1), none, lambda acc, s: F.when(s == "..", up(acc)).when(s.isin("", "."), acc).otherwise(F.array_append(acc, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _is_sound(path: Column, content: Column) -> Column:
    """The reason why a file's content is none of its kind, or null."""
    lines = F.filter(F.split(content, "\n", -1), lambda s: s.rlike(r"\S"))
    is_json = lambda s: F.try_parse_json(s).isNotNull()
    good = F.when(F.lower(path).rlike(r"[^/]\.json$"), is_json(content)).when(F.lower(path).rlike(r"[^/]\.jsonl$"), F.forall(lines, is_json))
    return F.when(~good, F.when(F.lower(path).endswith(".jsonl"), "invalid_jsonl").otherwise("invalid_json"))


def artifact_report(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """out_id, ok, status, failure_category, missing (array), invalid (array of path:reason), in the order declared.

    outputs: out_id (unique), folder (absolute), markdown (the expected file), sidecar (its JSON; null: there is none).
    files: path (absolute, unique), is_file, size, content (of .json and .jsonl files; null elsewhere). A record that is
    no JSON object is `sidecar_invalid`; one without success fails by its own category or as `artifact_incomplete`; a
    success with failed pages is a `page_failure`. Only then are the Markdown file and the artifacts looked up, each path
    once, relative ones below the folder: outside of it they are invalid, as are folders, empty files and bad JSON.
    """
    doc = F.try_parse_json("sidecar")
    text = lambda c, key: F.try_variant_get(c, f"$.{key}", "string")
    filled = lambda c: F.when(c != "", c)
    whole = lambda key: F.coalesce(F.try_variant_get(F.col("_doc"), f"$.{key}", "double"), F.lit(0.0)) >= 1
    listed = F.coalesce(F.try_variant_get(F.col("_doc"), "$.artifacts", "array<variant>"), F.expr("cast(array() AS array<variant>)"))
    of_one = lambda a: F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")).otherwise(text(a, "path"))
    read = outputs.withColumn("_doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)).withColumns({"_status": text(F.col("_doc"), "status")})
    category = (
        F.when(F.col("sidecar").isNull(), "artifact_missing").when(F.col("_doc").isNull(), "sidecar_invalid")
        .when(~F.coalesce(F.col("_status") == "success", F.lit(False)), F.coalesce(filled(text(F.col("_doc"), "failure_category")), F.lit("artifact_incomplete")))
        .when(whole("failed_pages") | whole("page_status_counts.error"), "page_failure")
    )
    own = F.coalesce(filled(text(F.col("_doc"), "output_md_path")), F.col("markdown"))
    paths = F.filter(F.array_distinct(F.concat(F.array(own), F.transform(listed, of_one))), lambda p: p != "")
    judged = read.select("out_id", "folder", "sidecar", "_status", category.alias("_category"), F.col("markdown"), F.when(category.isNull(), paths).alias("_paths"))
    at = judged.select("out_id", "folder", F.posexplode("_paths").alias("pos", "declared"))
    place = resolved(F.when(F.startswith("declared", F.lit("/")), F.col("declared")).otherwise(F.concat("folder", F.lit("/"), "declared")))
    inside = let(resolved(F.col("folder")), lambda f: (F.col("place") == f) | (f == "/") | F.startswith(F.col("place"), F.concat(f, F.lit("/"))))
    looked = at.withColumn("place", place).withColumn("inside", inside).join(files.withColumnRenamed("path", "place").withColumn("found", F.lit(True)), "place", "left")
    reason = (
        F.when(~F.col("inside"), "outside_output_dir").when(F.col("found").isNull(), "missing").when(~F.coalesce("is_file", F.lit(False)), "not_file")
        .when(F.coalesce("size", F.lit(0)) <= 0, "empty_file").otherwise(_is_sound(F.col("place"), F.coalesce("content", F.lit(""))))
    )
    bad = looked.select("out_id", F.struct("pos", "declared", reason.alias("reason")).alias("b")).where("b.reason IS NOT NULL")
    bad = bad.groupBy("out_id").agg(F.array_sort(F.collect_list("b")).alias("bad"))
    named = lambda keep, show: F.transform(F.filter("bad", keep), show)
    both = judged.join(bad, "out_id", "left").withColumn("bad", F.coalesce("bad", F.expr("cast(array() AS array<struct<pos: int, declared: string, reason: string>>)")))
    missing = F.when(F.col("sidecar").isNull(), F.array(F.concat("folder", F.lit("/.ocr_status.json")))).otherwise(named(lambda b: b["reason"] == "missing", lambda b: b["declared"]))
    invalid = F.when(F.col("_category") == "sidecar_invalid", F.array(F.concat("folder", F.lit("/.ocr_status.json:invalid_sidecar")))).otherwise(
        named(lambda b: b["reason"] != "missing", lambda b: F.concat_ws(":", b["declared"], b["reason"]))
    )
    found = both.select("out_id", F.when(F.col("_category") == "sidecar_invalid", "invalid").otherwise(F.col("_status")).alias("status"), "_category", missing.alias("missing"), invalid.alias("invalid"))
    failure = F.coalesce("_category", F.when(F.size("missing") > 0, "artifact_missing").when(F.size("invalid") > 0, "artifact_invalid"))
    return found.select("out_id", failure.isNull().alias("ok"), "status", failure.alias("failure_category"), "missing", "invalid")

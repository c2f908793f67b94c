"""Functions on the cases where they could go wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.functions import geometry as G
from sheaf.functions import text as T
from sheaf.operators import events as E
from sheaf.operators import jobs as J


def one(spark, column, **values):
    cells = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in cells.items())).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("message", "category"),
    [
        ("", "unknown"), ("Worker KILLED by OOM", "process_killed"), ("CUDA out of memory", "resource_exhausted"),
        ("input path /x does not exist", "input_missing"), ("No such file: a.pdf", "input_missing"), ("read timed out", "api_timeout"),
        ("HTTP 503 from server", "model_unavailable"), ("status code 500", "model_error"), ("permission denied: /out/a", "output_unwritable"),
        ("permission denied: source", "input_invalid"), ("file extension .doc", "input_invalid"), ("odd", "parser_failed"),
    ],
)
def test_failure_category(spark, message, category):
    assert one(spark, T.failure_category(F.col("m")), m=message) == category


def test_failure_category_prefers_what_is_given(spark):
    assert one(spark, T.failure_category(F.col("m"), F.col("c"), F.col("r")), m="timeout", c="mine", r=1) == "mine"
    assert one(spark, T.failure_category(F.col("m"), F.lit(None).cast("string"), F.col("r")), m="timeout", r=137) == "process_killed"
    assert one(spark, T.failure_category(F.col("m"), F.lit(""), F.col("r")), m="timeout", r=2) == "process_failed"


def test_words_and_languages(spark):
    assert one(spark, T.word_total(F.col("t")), t="# A `code` [link](x) it's 中文 ```b c```") == 5
    assert one(spark, T.script_language(F.col("t")), t="中文字 ab") == "Chinese"
    assert one(spark, T.script_language(F.col("t")), t="123") == "Others"
    assert one(spark, T.has_table(F.col("t")), t="|a|\n|b|\nx\n|c|") is False
    assert one(spark, T.has_table(F.col("t")), t="|a|\n|b|\n|c|") is True


def test_names_and_joins(spark):
    assert one(spark, T.caption_slug(F.col("t"), F.lit(3), F.lit(0)), t="Fig 1.2: the  plan!") == "page_3_Fig_1_2_the_plan"
    assert one(spark, T.caption_slug(F.col("t"), F.lit(3), F.lit(0)), t="!!") == "page_3_img_1"
    assert one(spark, T.joined_pair(F.col("a"), F.col("b")), a="exam-", b="ple") == "example"
    assert one(spark, T.joined_pair(F.col("a"), F.col("b")), a="one", b="two") == "one two"
    assert one(spark, T.human_bytes(F.col("s")), s="1.5 KB") == 1536
    assert one(spark, T.human_bytes(F.col("s")), s="2") == 2 * 1024**3
    assert one(spark, T.human_bytes(F.col("s")), s="lots") is None


def test_paths(spark):
    for path, ok in (("a/b.pdf", True), ("a/./b.PDF", True), ("/a.pdf", False), ("a/../b.pdf", False), ("a\\b.pdf", False), ("a.txt", False)):
        assert one(spark, T.valid_relative_path(F.col("p")), p=path) is ok
    assert one(spark, T.under_root(F.col("p"), F.col("r")), p="/data/x", r="/data/") is True
    assert one(spark, T.under_root(F.col("p"), F.col("r")), p="/database", r="/data") is False
    assert one(spark, T.tokens_in_order(F.col("t"), F.col("w")), t="a b a c", w=["b", "c"]) is True
    assert one(spark, T.tokens_in_order(F.col("t"), F.col("w")), t="c b", w=["b", "c"]) is False


def test_boxes(spark):
    a, b = [0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0]
    assert one(spark, G.iou(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(1 / 3)
    assert one(spark, G.overlap(F.col("a"), F.col("b")), a=a, b=[2.0, 2.0, 3.0, 3.0]) == 1.0
    assert one(spark, G.iou(F.col("a"), F.col("b")), a=[0.0] * 4, b=[0.0] * 4) == 0.0
    assert one(spark, G.clipped(F.col("p"), 100, 50), p=[-3.0, 4.2, 20.5, 60.0]) == [0.0, 4.0, 21.0, 50.0]
    assert one(spark, G.clipped(F.col("p"), 10, 10), p=[20.0, 20.0, 30.0, 30.0]) is None


def test_suppression_is_greedy(spark):
    rows = [(0.9, 0, [0.0, 0.0, 10.0, 10.0]), (0.8, 1, [0.0, 0.0, 10.0, 9.0]), (0.7, 2, [0.0, 0.0, 10.0, 7.0])]
    boxes = spark.createDataFrame(rows, "score double, index int, bbox array<double>").agg(F.collect_list(F.struct("score", "index", "bbox")).alias("b"))
    assert boxes.select(G.kept_boxes(F.col("b"), 0.75)).first()[0] == [0, 2]


SCHEMA = "job_id long, id long, ts timestamp_ntz, event_type string, file_path string, page_no long, status string, total_pages long, error string, output_path string"


def events(spark, *rows):
    import datetime as d

    full = [(1, k, d.datetime(2024, 1, 1, 0, 0, k), *r, *[None] * (7 - len(r))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_deduplication_bypasses_what_cannot_repeat(spark):
    df = events(spark, ("page_done", "a", 1), ("page_done", "a", 1), ("page_done", "a"), ("page_done", "a"), ("job_heartbeat", "a"), ("job_heartbeat", "a"), ("file_done", "a"), ("file_done", "a"), ("file_done",), ("file_done",))
    assert sorted(r["id"] for r in E.first_seen(df).collect()) == [0, 2, 3, 4, 5, 6, 8, 9]


def test_page_after_the_end_sets_running_again(spark):
    df = events(spark, ("file_started", "a", None, None, 7), ("file_failed", "a", None, None, None, "bad"), ("file_done", "a", None, None, None, None, "out"), ("page_done", "a", 2))
    row = E.file_states(df).first()
    assert (row["status"], row["error"], row["total_pages"], row["done_pages"], row["output_path"]) == ("running", None, 7, 1, "out")


def test_empty_events(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.counters(df).collect() == [] and E.file_states(df).collect() == []


def test_counts_fit_the_total(spark):
    good = J.reconciled(F.lit(10), F.lit(9), F.lit(4), F.lit(8))
    assert spark.range(1).select(*good).first()[:] == (4, 6, 0)
    free = J.reconciled(F.lit(0), F.lit(9), F.lit(4), F.lit(8))
    assert spark.range(1).select(*free).first()[:] == (4, 8, 9)


def test_rates(spark):
    rate, eta = J.rate_and_eta(F.lit(1), F.lit(100000.0), F.lit(5))
    assert spark.range(1).select(rate, eta).first()[:] == (0.0, None)
    with pytest.raises(ValueError):
        J.shard_index(F.lit(1), 0)

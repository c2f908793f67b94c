"""Folds, tables, layout, sources and streams on the cases that define them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sheaf.functions import text_udf as U
from sheaf.operators import folds, layout, tables
from sheaf.sources import jsonl_tail, manifest
from sheaf.streaming import ingest


def first(spark, rows, schema, column):
    return spark.createDataFrame([(rows,)], schema).select(column).first()[0]


def test_breaker(spark):
    calls = [(float(k), False) for k in range(5)] + [(10.0, True), (35.0, False), (40.0, True), (70.0, True), (71.0, True)]
    states = first(spark, calls, "x array<struct<at: double, ok: boolean>>", folds.breaker_states(F.col("x")))
    assert states == ["closed"] * 5 + ["open", "half_open", "open", "half_open", "closed"]


def test_limit_and_pause(spark):
    samples = [(0, 7, 0), (0, 16, 1), (1, 0, 0), (0, 0, 0)]
    got = first(spark, samples, "x array<struct<errors: int, inflight: int, waiting: int>>", folds.limit_trajectory(F.col("x"), 8, 20))
    assert got == [16, 20, 15, 15]
    assert first(spark, [1, 9, 5, 2, 5], "x array<int>", folds.hysteresis(F.col("x"), 2, 9)) == [False, True, True, False, False]


def test_spool_passes_over_lines_that_do_not_fit(spark):
    lines = ["a" * 3, "b" * 50, "c" * 9, "d" * 9]
    assert first(spark, lines, "x array<string>", folds.trimmed_spool(F.col("x"), 40)) == ["a" * 3, "c" * 9, "d" * 9]
    assert first(spark, lines, "x array<string>", folds.trimmed_spool(F.col("x"), 400)) == lines


def test_marker_levels(spark):
    lines = [("Title", None), ("Section-header", None), ("Text", None), ("Section-header", None), ("Section-header", 2), ("Section-header", 9)]
    got = first(spark, lines, "x array<struct<category: string, level: int>>", folds.marker_levels(F.col("x")))
    assert got == [1, 2, None, 3, 2, 3]


def test_otsl(spark):
    assert tables.otsl_html("<fcel>a<lcel><nl><fcel>b<fcel>c & d") == '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c &amp; d</td></tr></table>'
    assert tables.otsl_html("<fcel>a<fcel>b<nl><ucel><ecel><nl>") == '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td></td></tr></table>'
    assert tables.otsl_html("no table") == "" and tables.otsl_html(None) is None and tables.otsl_html("<table></table>") == "<table></table>"
    assert spark.createDataFrame([("<fcel>x<nl>",)], "m string").select(tables.otsl_to_html(F.col("m"))).first()[0] == "<table><tr><td>x</td></tr></table>"


def test_tables_over_a_page_break():
    a = "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>"
    b = "<table><tr><th>h</th><th>k</th></tr><tr><td>3</td><td>4</td></tr></table>"
    assert tables.merged_tables(a, b, 100, 95) == "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    assert tables.merged_tables(a, b, 100, 80) is None
    assert tables.merged_tables(a, "<table><tr><td>1</td></tr></table>", 100, 100) is None


def box(label, *bbox, score=0.5):
    return {"label": label, "bbox": [float(x) for x in bbox], "score": score}


def test_formulas():
    merged = layout.merged_formulas([box("inline_formula", 0, 0, 10, 10), box("text", 0, 0, 9, 9), box("display_formula", 1, 1, 9.5, 12, score=0.9)])
    assert [(b["label"], b["bbox"], b["score"]) for b in merged] == [("inline_formula", [0, 0, 10, 12], 0.9), ("text", [0.0, 0.0, 9.0, 9.0], 0.5)]
    labels = [b["label"] for b in layout.relabelled_formulas([box("inline_formula", 0, 0, 5, 5), box("display_formula", 20, 20, 25, 25), box("text", 0, 0, 30, 10)])]
    assert labels == ["inline_formula", "display_formula", "text"]


BOXES = "array<struct<label: string, score: double, bbox: array<double>>>"


def stay(spark, boxes, **how):
    page = spark.createDataFrame([([(b["label"], b["score"], b["bbox"]) for b in boxes],)], f"b {BOXES}")
    return [b["label"] for b in page.select(layout.without_overlaps(F.col("b"), **how)).first()[0]]


def test_overlaps(spark):
    boxes = [box("text", 0, 0, 3, 50), box("text", 0, 0, 50, 50), box("text", 0, 0, 40, 40), box("table", 0, 0, 45, 45), box("image", 1, 1, 44, 44), box("reference", 0, 0, 90, 90)]
    assert stay(spark, boxes) == ["text", "image"]
    assert stay(spark, [box("image", 0, 0, 50, 50), box("table", 1, 1, 49, 49)]) == ["image", "table"]
    formula = [box("inline_formula", 0, 0, 10, 10), box("text", 0, 0, 10, 30), box("inline_formula", 50, 50, 52, 60)]
    assert stay(spark, formula) == ["text"] and stay(spark, formula, drop_inline=False) == ["inline_formula", "text", "inline_formula"]
    assert stay(spark, []) == [] and stay(spark, [box("text", 0, 0, 9, 9)] * 3) == ["text"]


def cell(category, text, *bbox):
    return {"category": category, "text": text, "bbox": [float(x) for x in bbox or (0, 0, 1, 1)]}


def test_captions():
    cells = [cell("Caption", "one", 0, 0, 100, 10), cell("Table", "", 0, 20, 100, 90), cell("Table", "", 0, 200, 100, 300), cell("Caption", "two", 0, 310, 100, 320), cell("Caption", "far", 500, 0, 600, 10)]
    assert layout.table_captions(cells) == {1: 0, 2: 3}


def test_text_goes_on():
    cells = [cell("Text", "an exam-"), cell("Text", "ple of a"), cell("Text", "merge."), cell("Text", "Next"), cell("Table", ""), cell("Text", "more 1"), cell("Text", "digit")]
    assert [c["text"] for c in layout.merged_text(cells)] == ["an example of a merge.", "Next", "", "more 1", "digit"]


def merged(spark, *docs):
    rows = [(d, p, i, c["category"], c["text"]) for d, pages in enumerate(docs) for p, page in enumerate(pages) for i, c in enumerate(page)]
    out = layout.merged_over_pages(spark.createDataFrame(rows, "doc int, page int, i int, category string, text string")).orderBy("doc", "page", "i").collect()
    return [[[r["text"] for r in out if (r["doc"], r["page"]) == (d, p)] for p in range(len(pages))] for d, pages in enumerate(docs)]


def test_text_over_pages(spark):
    goes = [[cell("Text", "this goes"), cell("Page-footer", "1")], [cell("Page-header", "x"), cell("Text", "on here.")], [cell("Text", "end")]]
    blocked = [[cell("Text", "this goes"), cell("Table", "t")], [cell("Text", "on here.")]]
    header = [[cell("Text", "this goes")], [cell("Section-header", "1. new"), cell("Text", "on here.")]]
    plain = [[cell("Text", "this goes")], [cell("Section-header", "more"), cell("Text", "on here.")]]
    gap = [[cell("Text", "this goes")], [], [cell("Text", "on here.")]]
    hyphen = [[cell("Text", "an exam-")], [cell("Text", "ple of"), cell("Text", "it goes")], [cell("Text", "on")]]
    got = merged(spark, goes, blocked, header, plain, gap, hyphen)
    assert got[0] == [["this goes on here.", "1"], ["x"], ["end"]]
    assert got[1:3] == [[["this goes", "t"], ["on here."]], [["this goes"], ["1. new", "on here."]]]
    assert got[3:] == [[["this goes on here."], ["more"]], [["this goes"], [], ["on here."]], [["an example of"], ["it goes on"], []]]


def test_pages_in_spark(spark):
    schema = "page int, i int, label string, score double, bbox array<double>"
    rows = [(1, 0, "text", 0.5, [0.0, 0.0, 50.0, 50.0]), (1, 1, "text", 0.5, [0.0, 0.0, 40.0, 40.0]), (2, 0, "text", 0.5, [0.0, 0.0, 40.0, 40.0])]
    out = layout.per_page(spark.createDataFrame(rows, schema), ["page"], lambda boxes: boxes[:1])
    assert sorted((r["page"], r["i"]) for r in out.collect()) == [(1, 0), (2, 0)]


def test_text_repairs(spark):
    assert U.collapsed("ab" * 12 + " end") == "ab" * 5 + " end"
    assert U.collapsed("one two " * 11 + "x") == "one two " * 5 + "x"
    assert U.collapsed("fine text here") == "fine text here" and U.collapsed("") == "" and U.collapsed(None) is None
    assert U.normalised("Ａb-Ⅲ é") == "abiiié" and U.unescaped(r"A\\n", True) == "A\\\n"
    assert U.raised_citations("as shown¹²,³, here") == "as shown<sup>12,3</sup>, here"
    assert spark.createDataFrame([("a" * 20,), (None,)], "t string").select(U.collapse_repeats(F.col("t")).alias("o")).collect()[:] == [("aaaaa",), (None,)]


def test_manifest(spark, tmp_path):
    good = {"input_path": "/a/b.pdf", "relative_path": "b.pdf", "size_bytes": 3, "mtime_ns": 4}
    bad = [good | {"size_bytes": "3"}, good | {"relative_path": "../b.pdf"}, good | {"input_path": "a"}, good | {"mtime_ns": 1.5}, good | {"size_bytes": True}, good]
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(good), "{oops", *map(json.dumps, bad)]) + "\n")
    rows = manifest.read_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()
    assert [r["problem"] for r in rows] == [None, "bad_json", "bad_number", "bad_relative_path", "input_path_not_absolute", "bad_number", "bad_number", "duplicate_path"]


def test_directory_and_texts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, body in (("x/a.PDF", b"12"), ("b.pdf", b"1"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(body)
    assert [(r["path"].rsplit("/", 1)[1], r["size_bytes"]) for r in manifest.scan_directory(spark, str(tmp_path)).collect()] == [("b.pdf", 1), ("a.PDF", 2)]
    texts = spark.createDataFrame([(bytearray("é中".encode()),), (bytearray("中文".encode("gbk")),), (bytearray(b"\xff\xfe\x81"),)], "b binary")
    assert [r[0] for r in texts.select(manifest.decoded(F.col("b"))).collect()][:2] == ["é中", "中文"]


def test_tail_holds_back_partial_lines(tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_bytes(b'{"a": 1}\nbroken\n{"a": 2}')
    end, lines = jsonl_tail.complete_lines(str(path), 0)
    assert (end, [t for _, t in lines]) == (16, ['{"a": 1}'])
    path.write_bytes(b'{"a": 1}\nbroken\n{"a": 2}\n')
    assert jsonl_tail.complete_lines(str(path), end) == (25, [(16, '{"a": 2}')])
    assert jsonl_tail.complete_lines(str(tmp_path / "none"), 5) == (5, [])


def test_stream_of_events(spark, tmp_path):
    event = lambda **p: json.dumps({"type": "page_done", "job_id": "j", "created_at": "2024-01-01T00:00:00Z", "payload": p})
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "j.jsonl").write_text("\n".join([event(file_path="a", page_no=1), event(file_path="a", page_no=1), event(file_path="a", page_no=2), json.dumps({"x": 1})]) + "\n")
    jsonl_tail.register(spark)
    lines = spark.readStream.format("jsonl_tail").option("path", str(folder)).load()
    query = ingest.two_sinks(lines.select("line"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    stream = spark.readStream.schema("line string").text(str(folder)).toDF("line")
    counts = ingest.running_counts(ingest.deduplicated(ingest.parsed(stream).where("good")))
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [("j", "page_done", 2)]

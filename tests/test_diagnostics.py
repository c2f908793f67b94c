"""Recent lists, artifacts, cells, line ends, secrets and spools on the cases that tell their rules apart."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sheaf.functions import cells as C
from sheaf.functions import geometry, text_udf
from sheaf.functions import values as V
from sheaf.operators import artifacts, layout, policy, recent
from sheaf.sources import manifest

CELLS = "array<struct<category: string, bbox: array<double>, text: string>>"


def test_recent(spark):
    schema = "job_id int, event_id int, created_at int, event_type string, file_path string, failure_category string, error string"
    events = spark.createDataFrame([(1, k, t, "file_failed", f"p{k}", c, None) for k, t, c in ((1, 5, "a"), (2, None, "a"), (3, 9, "b"), (4, 5, "a"))], schema)
    samples = spark.createDataFrame([(j, s, p, None, f"s{p}", c, None) for j, s, p, c in ((1, "event_sample", 1, "b"), (2, "failed_file_sample", 1, "b"), (2, "event_sample", 2, "a"))], "job_id int, source string, pos int, event_type string, file_path string, failure_category string, error string")
    page = lambda *a, **k: [(r["job_id"], r["k"], r["file_path"], r["total"], r["has_more"]) for r in sorted(recent.recent_errors(events, samples, *a, **k).collect())]
    assert page(2) == [(1, 1, "p3", 4, True), (1, 2, "p4", 4, True), (2, 1, "s2", 2, False), (2, 2, "s1", 2, False)]
    assert page(2, 2) == [(1, 3, "p1", 4, False), (1, 4, "p2", 4, False)]
    assert page(5, category="b") == [(1, 1, "p3", 1, False), (2, 1, "s1", 1, False)]
    files = spark.createDataFrame([(1, 1, "a", "failed", 1), (1, 2, "b", "success", 2), (1, 3, "c", "error", 1), (2, 1, "a", "pending", 1)], "job_id int, file_id int, file_path string, status string, updated_at int")
    spare = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "d"), (1, 4, "d"), (1, 5, "e"), (2, 1, "x"), (2, 2, None)], "job_id int, pos int, file_path string")
    listed = lambda kind, n: [(r["job_id"], r["k"], r["file_path"], r["source"]) for r in sorted(recent.recent_files(files, spare, kind, n).collect())]
    assert listed("failed", 3) == [(1, 1, "c", "file"), (1, 2, "a", "file"), (1, 3, "d", "sample"), (2, 1, "x", "sample")]
    assert listed("failed", 0) == [(1, 1, "c", "file"), (2, 1, "x", "sample")] and listed("processed", 500) == [(1, 1, "b", "file"), (1, 2, "c", "file"), (1, 3, "a", "file")]


def test_artifacts(spark):
    good = '{"status": "success", "artifacts": [%s]}'
    cases = [None, "[1]", "x", '{"status": null}', '{"status": "success", "failed_pages": true}', good % "", good % '"/f/6/a.JSON", "/f/60/b"', good % '"..", "deep/./a/../b.jsonl", ""', '{"status": "success", "output_md_path": "other.md"}']
    outputs = spark.createDataFrame([(k, f"/f/{k}", f"/f/{k}/m.md", c) for k, c in enumerate(cases)], "out_id int, folder string, markdown string, sidecar string")
    files = [(f"/f/{k}/m.md", True, 3, None) for k in (5, 6, 7)] + [("/f/6/a.JSON", True, 1, "{"), ("/f/60/b", True, 1, None), ("/f/7/deep/b.jsonl", True, 9, "1\n\n{}\n"), ("/f/8/other.md", False, 0, None)]
    got = {r["out_id"]: tuple(r)[1:] for r in artifacts.artifact_report(outputs, spark.createDataFrame(files, "path string, is_file boolean, size long, content string")).collect()}
    bad = (False, "invalid", "sidecar_invalid", [], )
    assert got == {
        0: (False, None, "artifact_missing", ["/f/0/.ocr_status.json"], []), 1: (*bad, ["/f/1/.ocr_status.json:invalid_sidecar"]), 2: (*bad, ["/f/2/.ocr_status.json:invalid_sidecar"]),
        3: (False, None, "artifact_incomplete", [], []), 4: (False, "success", "page_failure", [], []), 5: (True, "success", None, [], []),
        6: (False, "success", "artifact_invalid", [], ["/f/6/a.JSON:invalid_json", "/f/60/b:outside_output_dir"]), 7: (False, "success", "artifact_invalid", [], ["..:outside_output_dir"]),
        8: (False, "success", "artifact_invalid", [], ["other.md:not_file"]),
    }


def test_cells(spark):
    one = lambda cells, of: spark.createDataFrame([(cells,)], f"c {CELLS}").select(of(F.col("c"))).first()[0]
    texts = [("Text", None, "An AD here"), ("Title", None, "ad"), ("Footnote", None, None), (None, None, "ad"), ("Page-header", None, "h"), ("Page-footer", None, "f")]
    left = lambda of: [c["text"] for c in one(texts, of)]
    assert left(lambda c: C.without_keywords(c, ["Ad"])) == ["ad", None, "ad", "h", "f"] and len(left(lambda c: C.without_keywords(c, []))) == 6
    assert left(lambda c: C.without_furniture(c, keep_header=True, skip_footnote=True)) == ["An AD here", "ad", "ad", "h"]
    page = [("Picture", [0.0, 0.0, 100.0, 100.0], None), ("Caption", [0.0, 105.0, 100.0, 120.0], "first"), ("Picture", [0.0, 130.0, 100.0, 230.0], None), ("Caption", [0.0, 235.0, 100.0, 250.0], "second"), ("Picture", [900.0, 900.0, 910.0, 910.0], None)]
    assert [tuple(m) for m in one(page, C.figure_captions)] == [(0, 1), (2, 3), (4, None)] and one([], C.figure_captions) == []
    assert [tuple(m) for m in one([page[1], page[0], page[2]], C.figure_captions)] == [(1, 0), (2, None)]
    before = [("Text", [1.0, 2.0, 3.0, 4.0], ""), ("Table", [1.4, 2.5, 3.5, 4.0], ""), ("Table", [1.0, 2.0, 4.0, 4.0], ""), ("Table", [1.0], "")]
    after = [("Table", [0.6, 2.0, 3.6, 4.4], ""), ("Text", [1.0, 2.0, 4.0, 4.0], ""), ("Table", [9.0, 2.0, 4.0, 4.0], ""), ("Table", None, "")]
    got = spark.createDataFrame([(before, after)], f"b {CELLS}, a {CELLS}").select(C.original_tables(F.col("a"), F.col("b"))).first()[0]
    assert got == [1, None, None, None]


@pytest.mark.parametrize(("text", "want"), [
    (r"a\nb\r\nc\rd\te", "a\nb\nc\nd\\te"), (r"$\n$\n", "$\\n$\n"), (r"$$\n$\n$$\n", r"$$\n$\n$$\n"), (r"\$\n\$", "\\$\n\\$"), (r"\\$\n$\n", "\\\\$\\n$\n"),
    (r"\(\[\n\)\]\n\)\n", "\\(\\[\\n\\)\\]\\n\\)\n"), (r"\)\n", "\\)\n"), (r"\\n", "\\\n"), (r"\$$\n$", r"\$$\n$"), ("plain", "plain"), ("", ""),
])
def test_line_ends(text, want):
    assert text_udf.line_ends_outside_math(text) == want


def test_long_line_ends_and_nulls(spark):
    assert len(text_udf.line_ends_outside_math(r"$a$\n" * 300_000)) == 1_200_000
    rows = spark.createDataFrame([(None,), ("x",), (r"\n",)], "t string").select(text_udf.with_line_ends(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None, "x", "\n"]


def test_secrets(spark):
    config = {"api-key": 1, "x": [{"My_Token": {"a": 1}, "tokens": "kept"}, ["s"]], "Authorization": None, "secretary": "kept"}
    want = {"api-key": "[redacted]", "x": [{"My_Token": "[redacted]", "tokens": "kept"}, ["s"]], "Authorization": "[redacted]", "secretary": "kept"}
    rows = spark.createDataFrame([(json.dumps(config),), (None,), ("{",), ("3",)], "t string").select(text_udf.redacted_json(F.col("t"))).collect()
    assert json.loads(rows[0][0]) == want and [r[0] for r in rows[1:]] == [None, None, "3"]


def test_spools(spark, tmp_path):
    for name, text in {"a/events.jsonl": "{}\n \n{}\n", "a/logs.failed.jsonl": "x", "a/events.dropped.json": '{"dropped": 4}', "b c/logs.jsonl": "", "b c/logs.dropped.json": '{"dropped": -4}', "b c/other.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["dir"].rsplit("/", 1)[1].replace("%20", " "): r for r in manifest.spool_gauges(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b c"}
    assert (rows["a"]["pending_events"], rows["a"]["pending_event_bytes"], rows["a"]["failed_logs"], rows["a"]["failed_log_bytes"], rows["a"]["dropped_events"]) == (2, 8, 1, 1, 4)
    assert set(rows["b c"][1:]) == {0}
    work = tmp_path / "jobs" / "1" / "pending-shard-updates"
    work.mkdir(parents=True)
    for name in ("shard-1.json", "shard-2.json", "shard-2.json.failed", "other.json"):
        (work / name).write_text("{}")
    assert tuple(manifest.pending_updates(spark, str(tmp_path)).first()) == (2, 1)


def cell(page, category, top, bottom, text="", **more):
    return {"page": page, "category": category, "bbox": [0.0, float(top), 100.0, float(bottom)], "text": text, **more}


@pytest.mark.parametrize(("cells", "want"), [
    ([], []),
    ([cell(1, "Table", 0, 50, caption="A"), cell(2, "Page-header", 0, 5), cell(2, "Table", 10, 50, caption="B"), cell(2, "Caption", 60, 70, "B", taken=True), cell(2, "Text", 71, 75), cell(3, "Table", 0, 50)],
     [(0, 0, "A"), (2, 0, "A"), (5, 1, None)]),
    ([cell(1, "Caption", 0, 10, " T "), cell(1, "Table", 20, 50), cell(2, "Table", 0, 50)], [(1, 0, "T"), (2, 0, "T")]),
    ([cell(1, "Table", 0, 20), cell(1, "Footnote", 22, 24), cell(1, "Table", 30, 40), cell(2, "Table", 0, 9)], [(0, 0, None), (3, 0, None), (2, 1, None)]),
    ([cell(1, "Table", 0, 20), cell(1, "Text", 22, 24), cell(2, "Table", 0, 9), cell(2, "Caption", 12, 14, "X"), cell(2, "Caption", 16, 18, "Y")], [(0, 0, None), (2, 1, None)]),
    ([cell(1, "Table", 0, 20), cell(2, "Table", 0, 9), cell(2, "Caption", 12, 14, "X"), cell(2, "Caption", 16, 18, "Y")], [(0, 0, "X"), (1, 0, "X")]),
    ([cell(1, "Caption", 0, 9, "far"), cell(14, "Table", 0, 9), cell(15, "Caption", 0, 2, "near")], [(1, 0, "near")]),
    ([cell(1, "Caption", 0, 9, "p", locked=True), cell(1, "Table", 10, 19)], [(1, 0, None)]),
    ([cell(1, "Table", 10, 19), cell(1, "Caption", 12, 15, "inside")], [(0, 0, None)]),
])
def test_table_groups(cells, want):
    assert layout.table_groups(cells) == want


def test_integrity_issues(spark):
    names = "bad_scan_units bad_shards scan_units meta_bytes|ok scan_unit_rows_match scan_unit_bytes_match manifest_exists manifest_rows_match manifest_bytes_match meta_exists meta_rows_match meta_bytes_match shard_rows_match|manifest_error meta_error meta_path"
    kinds = [f"{n} {kind}" for part, kind in zip(names.split("|"), ("int", "boolean", "string"), strict=True) for n in part.split()]
    good = dict.fromkeys((k.split()[0] for k in kinds), None) | {k.split()[0]: True for k in kinds if k.endswith("boolean")}
    cases = [good, good | {"bad_shards": 2, "bad_scan_units": 1}, good | {"ok": False}, good | {"ok": None, "scan_units": 1, "scan_unit_bytes_match": None, "manifest_exists": False}, good | {"ok": False, "manifest_error": "x", "meta_exists": False, "shard_rows_match": None},
             good | {"ok": False, "meta_exists": None, "meta_rows_match": False}, good | {"ok": False, "meta_path": "m", "meta_bytes_match": False}, good | {"ok": False, "meta_path": "m", "meta_bytes": 1, "meta_bytes_match": False}]
    rows = spark.createDataFrame([tuple(c[k.split()[0]] for k in kinds) + (i,) for i, c in enumerate(cases)], ", ".join([*kinds, "i int"])).orderBy("i")
    assert [r[0] for r in rows.select(policy.integrity_issues().alias("n"), "i").orderBy("i").collect()] == [0, 3, 0, 1, 3, 0, 0, 1]


@pytest.mark.parametrize(("markdown", "tables", "want"), [
    ("a <t>1</t> b <t>1</t> c", [{"html": "<t>1</t>"}, {"text": " <t>1</t>\n"}, {"html": "zzz"}], [(10, "snippet"), (21, "snippet"), (23, "append-end")]),
    ("x <b>a \n c</b> y", [{"html": " ", "text": "<b>a c</b>"}], [(14, "snippet")]),
    ("p <TABLE><tr></Table> q <table>", [{"html": "zz"}, {"text": None}], [(21, "html-tag"), (24, "html-tag")]),
    ("Tab  1 here", [{"caption": "**Tab 1**"}], [(6, "caption")]), ("", [{"html": "x"}], [(0, "append-end")]), ("abc", [], []),
])
def test_table_places(markdown, tables, want):
    assert text_udf.table_places(markdown, tables) == want


def test_references(spark):
    rows = [("a T b", [("T", None, None, "![1]"), (None, None, None, "![2]")]), (None, []), ("x", None), ("T", [("T", None, None, None)])]
    frame = spark.createDataFrame(rows, "m string, t array<struct<html: string, text: string, caption: string, reference: string>>")
    assert [r[0] for r in frame.select(text_udf.with_references(F.col("m"), F.col("t"))).collect()] == ["a T\n\n![1] b\n\n![2]", None, "x", "T"]


def test_provenance(spark):
    names = {"abc": True, "v1.2.3-rc": True, "1.2.3": True, "10.0.0.1": False, "300.0.0.1": True, "my-Token": False, "tenant1": False, "localhost": False, "a.lan": False, "host.example": False, "a b": False, "": False, "-a": False, "a\n": False, "m.x1": True, None: None}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in frame.select("n", V.safe_identifier(F.col("n"))).collect()} == names
    digest = "sha256:" + "AB" * 32
    rows = [("p", {"model": "r1", "layout": None}, {"model": digest}), ("p", None, None), (None, {}, {}), ("p", {"model": "a b"}, {}), ("p", {}, {"model": digest + "0"})]
    got = spark.createDataFrame(rows, "p string, r map<string, string>, d map<string, string>").select(V.safe_provenance(F.col("p"), F.col("r"), F.col("d"))).collect()
    assert [r[0] and tuple(r[0]) for r in got] == [("p", {"model": "r1"}, {"model": digest.lower()}), ("p", {}, {}), None, None, None]


def test_fit_in_resized(spark):
    size = lambda w, h: (F.lit(w), F.lit(h))
    fits = lambda boxes: spark.createDataFrame([(boxes,)], "b array<array<double>>").select(geometry.fits_resized(F.col("b"), size(500, 500), size(1000, 1000))).first()[0]
    assert fits([[0.0, 0.0, 490.0, 510.0], [5.0, 5.0, 1.0, 1.0], [1.0]]) and not fits([[0.0, 0.0, 990.0, 990.0]]) and not fits([]) and not fits([[1.0, 1.0, 1.0, 2.0]]) and not fits(None)
    assert fits([[0.0, 0.0, 400.0, 400.0]]) and not fits([[0.0, 0.0, 400.0, 400.0], [0.0, 0.0, 600.0, 600.0]])


def test_rescaled_boxes(spark):
    def boxes(value, resized=(200, 50), original=(100, 100)):
        sizes = [(F.lit(w), F.lit(h)) for w, h in (resized, original)]
        return spark.createDataFrame([(value,)], "b array<array<double>>").select(geometry.rescaled_boxes(F.col("b"), *sizes)).first()[0]

    assert boxes([[20.0, 5.0, 101.0, 25.0], [1.0], None]) == [[10.0, 10.0, 50.0, 50.0], [1.0], None]
    assert boxes([[-2.0, 5.0, 208.0, 51.0], [0.0, 0.0, 1.0, 1.0]]) == [[0.0, 10.0, 100.0, 100.0], [0.0, 0.0, 0.0, 2.0]]
    assert boxes([[0.0, 0.0, 210.0, 10.0], [0.0, 0.0, 10.0, 10.0]]) == [[0.0, 0.0, 210.0, 10.0], [0.0, 0.0, 10.0, 10.0]]
    assert boxes([[1.5, 1.0, 2.0, 2.0]], (100, 100)) == [[1.5, 1.0, 2.0, 2.0]] and boxes([[1.5, 1.0, 2.0, 2.0]], (0, 50)) == [[1.5, 1.0, 2.0, 2.0]]
    assert boxes([]) == [] and boxes(None) is None

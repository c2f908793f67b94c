"""Markup, paths, times and detections."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import functions as F

from sheaf.functions import markup as M


def test_markup(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(M.single_braces(F.lit(r"\{\{a\}\}\}"))) == r"\{a\}"
    assert one(M.smart_joined(F.array(*map(F.lit, ("one", "two", "中", "3", "!"))))) == "one two中3!"
    assert one(M.on_one_line(F.lit("## A\n b\n\nc"), F.lit("Title"))) == "## A b c" and one(M.on_one_line(F.lit("a\nb"), F.lit("Table"))) == "a\nb"
    assert [one(M.formula_body(F.lit(x))) for x in ("$$ a $$", r"\[b\]", r"\( c \)", "$d$", "e")] == ["a", "b", "c", "d", "e"]
    cases = {
        "$x$": "$x$", " ": "", " $$ x $$ ": "$$\nx\n$$", "$$ a $ b $$": "$$ a $ b $$", "$$ x": "x", r"\alpha $$": "$$\n\\alpha\n$$", "$$ x\ny": "$$ x\ny", r"\[ x \]": "$$\nx\n$$",
        r"so \[x\] is": r"so \[x\] is", "plain prose": "plain prose", r"a \frac{1}{2}": "$$\na \\frac{1}{2}\n$$", r"`\beta`": "$$\n\\beta\n$$", r"\usepackage{x}\beta": "$$\n\\beta\n$$",
        r"\{\{\beta\}": "$$\n\\{\\beta\\}\n$$", "$$": "$$\n\n$$",
    }
    for text, want in cases.items():
        assert one(M.formula_block(F.lit(text))) == want, text
    assert one(M.without_images(F.lit("a\n\n![x](y)\n\nb"))) == "a\n\nb"
    assert one(M.without_fences(F.lit("```json\n{}\n```"))) == "{}" and one(M.without_fences(F.lit("x ``` y"))) == "x ``` y"
    assert one(M.valid_escapes(F.lit(r'"\d\n"'))) == r'"\\d\n"'
    assert one(M.compact_html(F.lit(" <a>\n <b>x  y</b> "))) == "<a><b>x y</b>"


def test_paths_and_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    cases = {
        "a/../b?c//./d e.pdf": "a/unnamed/b_c/unnamed/d e.pdf", "": "unnamed", "..": "unnamed", "//x/ y /z": "x/y/z", "a/..b": "a/b", None: "unnamed",
        "d/" + "x" * 300 + ".pdf": "d/" + "x" * (255 - 4 - 10) + "_" + hashlib.md5(("d/" + "x" * 300 + ".pdf").encode()).hexdigest()[:8] + ".pdf",
        "é" * 200: "é" * (245 // 2) + "_" + hashlib.md5(("é" * 200).encode()).hexdigest()[:8],
    }
    for key, want in cases.items():
        assert one(M.local_path(F.lit(key))) == want, key
    assert [one(M.safe_component(F.lit(x))) for x in (" a/b:c ", "...", " ", None)] == ["a_b_c", "...", "unnamed", "unnamed"]
    assert one(M.output_stem(F.lit("a/b.c.pdf"))).startswith("b.c_") and one(M.output_stem(F.lit("x/b.pdf"))) != one(M.output_stem(F.lit("y/b.pdf")))
    assert one(M.bare_identifier(F.lit(" 978 1 "))) == "9781" and one(M.bare_identifier(F.lit("  "))) is None
    want = datetime.datetime(2024, 1, 2, 3, 4, 5)
    for text in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "Tue, 2 Jan 2024 03:04:05 +0000"):
        assert one(M.tolerant_time(F.lit(text)).cast("timestamp_ntz")) == want
    assert one(M.tolerant_time(F.lit("soon"))) is None


def test_blocks(spark):
    blocks = [("text", [0.0, 0.0, 500.0, 500.0]), ("header", [0.0, 0.0, 500.0, 500.0]), ("text", [0.0, 0.0, 1.0, 1.0]), ("title", [0.0, 0.0, 100.0, 100.0])]
    frame = spark.createDataFrame([(blocks,)], "b array<struct<kind: string, bbox: array<double>>>")
    assert [b["kind"] for b in frame.select(M.kept_blocks(F.col("b"), ["header"], 0.001, 5)).first()[0]] == ["text", "title"]
    cells = [("Text", [0.0] * 4), ("", [0.0] * 4), ("Text", [0.0] * 3)]
    frame = spark.createDataFrame([(cells,), (cells[:1],), (cells[2:],)], "c array<struct<category: string, bbox: array<double>>>")
    assert [r[0] for r in frame.select(M.first_bad_cell(F.col("c"))).collect()] == [1, None, 0]
    one = lambda c: spark.range(1).select(c).first()[0]
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(M.page_dpi(F.lit(720.0), F.lit(720.0), 200, 1_000_000)) == 100 and one(M.page_dpi(F.lit(72.0), F.lit(72.0), 200, 1_000_000)) == 200
    assert one(M.reading_order(F.array(numbers(0, -1, -1), numbers(1, 0, 1), numbers(1, -1, 0)))) == [1, 2, 0]
    assert [tuple(x) for x in one(M.top_boxes(numbers(0.1, 0.9, 0.4, 0.9), 2, 3))] == [(0.9, 0, 1), (0.9, 1, 1), (0.4, 1, 0)]
    assert M.hash_distance_limit(64, 90) == 6

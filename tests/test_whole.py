"""Queries over whole tables and whole texts, on fixtures that a cut would show."""

from __future__ import annotations

import numpy as np
import pytest

from sheaf.plans import catalogue, layout


@pytest.mark.parametrize("block", [layout.HASHES, 40])
def test_all_vectors_and_components_count(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(layout, "HASHES", block)
    rng, rows = np.random.default_rng(3), []
    for label in (0, 1):
        for _ in range(20):
            centre = rng.standard_normal(64)
            for flips in (0, 2, 17, 18, 19):
                v = centre.copy()
                v[64 - flips :] *= -1  # the last components differ first
                rows.append((1900 + len(rows), [float(x) for x in v], label))
    rows += [(9001, rows[0][1], None), (9002, None, 0), (9003, rows[0][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["near_dup_groups"](spark, str(tmp_path)).select("a", "b", "distance").collect()))
    signs = [(i, np.array(v) > 0, label) for i, v, label in rows if v and label is not None]
    want = [(i, j, int((x != y).sum())) for i, x, k in signs for j, y, m in signs if i < j and k == m and (x != y).sum() <= 18]
    assert got == sorted(want) and len(want) > 200


def test_every_output_is_checked(spark, tmp_path):
    items = [(1, "red fox ran"), (2, "red"), (3, "fox red"), (4, None), (5, "red hen"), (6, "cat  dog")]
    docs = [(k, t, s) for k, t in enumerate(["a red fox", "fox and red", "red only", None, "", "cat", "hen red fox", "redfox"] * 2) for s in ("a", None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text, _ in docs:
        for item, x in items:
            a, b = (x.split(" ") + [None])[:2] if x else (None, None)
            if text is not None and b is not None and a in text:
                want.append((i, item, b in text, b in text[text.index(a) + len(a) :]))
    got = catalogue.QUERIES["fixture_check"](spark, str(tmp_path)).select("doc_id", "item_id", "has_fields", "in_order").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 60


def test_author_blocks_are_scored_whole(spark, tmp_path):
    filler = "lorem ipsum dolor " * 150
    rows = [
        (1, filler + "mail@example.org University Hospital School 12345", None), (2, filler, None), (3, "mail@example.org University Hospital School 12345 " + "the of " * 2000, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["author_block_score"](spark, str(tmp_path)).orderBy("doc_id").select("score", "is_author_block").collect()
    assert list(map(tuple, got)) == [(8, True), (0, False), (0, False)]


def test_whole_turns_are_merged(spark, tmp_path):
    long = "word " * 30
    rows = [(1, 0, long + "ends here."), (1, 1, long + "is cut in"), (1, 2, long + "hyphen-"), (1, 3, "ation " + long + "end."), (2, 0, "never ends"), (2, 1, None), (3, 0, None), (3, 1, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["text_merge_candidates"](spark, str(tmp_path)).select("conv_id", "turn", "merged_chars").collect()))
    assert got == [(1, 1, len(long + "is cut in") + 1 + len(long + "hyphen-")), (1, 2, len(long + "hyphen") + len("ation " + long + "end."))]

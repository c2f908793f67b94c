from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from sheaf.llm import queries
from tests.llm.test_mix_and_shard import targets, words
from tests.llm.test_models import found_by_brute_force
from tests.llm.test_near_duplicates import classes

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the provided tables")


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, bench = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        rows, after = docs.collect(), spark.read.parquet(str(tmp_path / name))
        texts, kept[name] = [(r["doc_id"], r["text"]) for r in rows], after.collect()
        ids = Counter(r["doc_id"] for r in kept[name])
        if name == "language_id":
            assert len(ids) >= 0.98 * len(rows)
        elif name == "near_dedup":
            assert set(ids) == set(classes(texts).values()) and max(ids.values()) == 1
        elif name == "decontamination":
            leaks = {texts[row][0] for row, _ in found_by_brute_force(texts, bench)}
            assert leaks and set(ids) == {i for i, _ in texts} - leaks
        elif name == "mixing":
            sizes, took = Counter(), Counter()
            for r in rows:
                sizes[r["source"]] += words(r["text"])
            for r in kept[name]:
                took[r["source"]] += words(r["text"])
            largest = {s: max(words(r["text"]) for r in rows if r["source"] == s) for s in sizes}
            assert all(abs(took[s] - t) <= largest[s] for s, t in targets(sizes).items()) and max(ids.values()) <= 2
        if name != "sharding":
            assert after.columns == columns
            docs = after
    shards = Counter(r["shard"] for r in kept["sharding"])
    assert max(shards.values()) - min(shards[k] for k in range(16)) <= 1
    assert Counter(r["doc_id"] for r in kept["sharding"]) == Counter(r["doc_id"] for r in kept["mixing"])


def test_registration(spark):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert corpus_pipeline.run(spark, SMALL).count() > 0

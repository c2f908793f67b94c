"""Training-data operators on inputs that a cut would show."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from sheaf.llm import decontaminate, embedding_dedup, minhash_dedup
from tests.llm.conftest import prose
from tests.llm.test_models import found_by_brute_force


def test_unlike_texts_with_one_id_or_none_stay(spark):
    rows = [(None, prose(k, 60)) for k in range(10)] + [(None, prose(3, 60)), (7, prose(20, 60)), (7, prose(21, 60)), (7, prose(21, 60)), (8, prose(20, 60)), (None, prose(20, 60)), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, minhash_dedup.without_near_documents(docs).collect()))
    assert kept == Counter({**{(None, prose(k, 60)): 1 for k in range(10)}, (7, prose(20, 60)): 1, (7, prose(21, 60)): 1, (None, None): 2})


def test_items_cut_by_a_short_text_and_far_fingerprints(spark):
    items = [(k, prose(6000 + k, 40 + k)) for k in range(20)]
    docs = [(k, " ".join(items[k][1].split(" ")[: 35 + k])) for k in range(20)]
    for k in range(400):  # most of an item inside other prose, cut at one end
        item = items[k % 20][1].split(" ")
        docs.append((1000 + k, f"{prose(2 * k, 60)} {' '.join(item[len(item) // 6 - k % 3 :] if k % 2 else item[: len(item) - len(item) // 6 + k % 3])} {prose(9000 + k, 60)}"))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, bench).collect()}
    want = {(docs[row][0], i) for row, i in found_by_brute_force(docs, items)} | {(k, k) for k in range(20)}
    assert set(got) == want and len(want) > 200 and max(r["hamming"] for r in got.values()) > 23
    assert all(got[k, k]["n_words"] == 35 + k and got[k, k]["first_word"] == 0 for k in range(20))
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_recall_of_tables_at_wide_keys():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    z = rng.standard_normal(v.shape)
    z -= (z * v).sum(axis=1, keepdims=True) * v
    near = 0.93 * v + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for bits in (8, 13, 14, 16):
        rotation = embedding_dedup.learn_rotation(v, bits, 0.93, rounds=10)
        found = (embedding_dedup.table_keys(embedding_dedup._bits(v, rotation), rotation) == embedding_dedup.table_keys(embedding_dedup._bits(near, rotation), rotation)).any(axis=1).mean()
        assert found > 0.95


def test_weights_are_those_of_the_whole_benchmark(spark, monkeypatch):
    shared = prose(31, 12)
    items = [(k, f"{prose(7000 + k, 20)} {shared if k % 2 else prose(8000 + k, 12)}") for k in range(24)] + [(99, None), (None, prose(1, 30)), (98, "tiny one"), (97, "")]
    docs = [(k, f"{prose(k, 50)} {' '.join((items[k % 24][1]).split(' ')[: 32 - k % 9])} {prose(500 + k, 50)}") for k in range(96)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(docs[row][0], i) for row, i in found_by_brute_force(docs, items)}
    whole = sorted(map(tuple, decontaminate.contaminated(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    got = sorted(map(tuple, decontaminate.contaminated(frame, bench).collect()))
    assert {r[:2] for r in got} == want and got == whole and len(want) > 30
    assert {r["doc_id"] for r in decontaminate.without_contaminated(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}

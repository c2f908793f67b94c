from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheaf.llm import embedding_dedup, graph, minhash_dedup
from tests.llm.conftest import prose


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    want = grouped(links, {n for x in links for n in x})
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want
    monkeypatch.setattr(graph, "TASK_LINKS", -1)
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).collect() == []


def shingled(text):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return tuple(words), Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def classes(rows):
    """All pairs by the multiset similarity of their shingles; rows: (id, text)."""
    known, pairs = [(i, *shingled(t)) for i, t in rows], []
    for k, (i, words, own) in enumerate(known):
        for j, others, its in known[:k]:
            both = sum((own & its).values())
            if words and (words == others or (both and both >= 0.8 * (sum(own.values()) + sum(its.values()) - both))):
                pairs.append((i, j))
    return grouped(pairs, {i for i, _ in rows})


def changed(text, edits, rng):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def made():
    rng = random.Random(8)
    rows = [(k, prose(100 + k, 150)) for k in range(30)]
    for k in range(60):
        rows.append((1000 + k, changed(rows[rng.randrange(5)][1], rng.choice((1, 1, 2, 3, 6)), rng)))
    hub = prose(999, 200)
    rows += [(2000 + k, changed(hub, 3, rng)) for k in range(60)]  # close to the hub, not all to each other
    rows += [(3000, hub), (3001, hub.upper() + "!!"), (3002, prose(100, 150))]
    passage = prose(555, 60)  # shared by texts that are else different
    rows += [(4000 + k, prose(700 + k, 90) + " " + passage) for k in range(15)]
    return rows


def test_documents_against_all_pairs(spark, monkeypatch):
    rows, want = made(), None
    want = classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, block in ((minhash_dedup.BROADCAST_BYTES, minhash_dedup.BLOCK), (-1, 7)):
        monkeypatch.setattr(minhash_dedup, "BROADCAST_BYTES", size)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_documents(df).collect()}
        assert got == want
    stay = {r["doc_id"] for r in minhash_dedup.without_near_documents(df).collect()}
    assert stay == set(want.values())


def test_awkward_documents(spark, awkward, nothing):
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in minhash_dedup.near_documents(awkward).collect()]
    assert len(got) == awkward.count()
    assert Counter(got)[9, 9, True] == 2 and (8, 1, False) in got and (3, 3, True) in got and (4, 4, True) in got and (None, None, True) in got
    kept = minhash_dedup.without_near_documents(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, None, None])
    assert minhash_dedup.near_documents(nothing).collect() == [] and minhash_dedup.without_near_documents(nothing).collect() == []


def test_alignment():
    a = np.arange(500, dtype=np.uint32)
    assert minhash_dedup.aligned_similarity(a, a, 0.8) == 1.0
    b = a.copy()
    b[[100, 300]] = 9999
    assert minhash_dedup.aligned_similarity(a, b, 0.8) == pytest.approx(486 / 506)
    assert minhash_dedup.aligned_similarity(a, np.concatenate([a[250:], a[:250]]), 0.8) == 0.0  # order counts
    assert minhash_dedup.aligned_similarity(a, a[:350], 0.8) == 0.0 and minhash_dedup.aligned_similarity(a[:3], a[:3], 0.8) == 0.0


def test_sketches_keep_order_and_occurrences():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    doubled = np.concatenate([words[:50], words[:50]])
    assert len(set(minhash_dedup.labelled_shingles(doubled).tolist())) == 96
    for found in (words, words[:40], words[:7], words[:6], words[:5]):
        own = minhash_dedup.labelled_shingles(found)
        values = (own * minhash_dedup._ODD[:, None]) >> np.uint64(32)
        least = np.sort(np.argsort(values, axis=1)[:, : minhash_dedup.ORDER], axis=1)
        want = np.zeros(len(values), np.uint64)
        for column in least.T:
            want = want * np.uint64(minhash_dedup.W.BASE) + own[column]
        assert (minhash_dedup._sketches(own, minhash_dedup._ODD) == minhash_dedup.W.mix(want)).all()


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng, rows, at = np.random.default_rng(4), [], 0
    for label in range(3):
        for centre in rng.standard_normal((40, 16)):
            for _ in range(int(rng.integers(1, 12))):
                rows.append((at, [float(x) for x in centre + rng.standard_normal(16) * rng.choice((0.0, 0.1, 0.2, 0.3))], label))
                at += 1
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5, []]
    rows += [(10_000 + k, v, 1) for k, v in enumerate(odd)] + [(10_100, rows[0][1], None), (10_101, rows[0][1], None), (0, rows[0][1], 0), (10_102, [0.0] * 16, 1)]
    rows += [(11_000, [1.0, 2.0], 1), (11_001, [1.0, 2.0], 1), (11_002, [2.0, 4.1], 1), (11_003, [-1.0, 2.0], 1), (11_004, [1.0, 2.0], 2), (11_005, [3.0], 2)]
    return rows


def brute_links(rows):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.float32(rows[k][1]).astype(float) / np.linalg.norm(np.float32(rows[k][1]).astype(float)) for k in ok}
    return [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    pairs = brute_links(rows)
    degree = Counter(k for pair in pairs for k in pair)
    root = grouped(pairs, set(range(len(rows))))
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(least[root[k]], i)
    want = Counter((i, degree[k], least[root[k]], i == least[root[k]]) for k, (i, _, _) in enumerate(rows))
    got = Counter(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()))
    found = sum(n * c for (_, n, _, _), c in got.items())
    assert found >= 0.97 * sum(degree.values()) and sum(got.values()) == len(rows)
    assert sum((got & want).values()) >= 0.93 * len(rows)
    assert all(got[x] == want[x] for x in want if x[0] >= 10_000)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (None, None, 1), (2, [0.0], 1)], VECTORS)
    assert sorted(map(repr, map(tuple, embedding_dedup.near_vectors(blank).collect()))) == sorted(map(repr, [(1, 0, 1, True), (None, 0, None, True), (2, 0, 2, True)]))


def test_labels_of_any_type_and_extra_columns(spark):
    rows = [(1, [1.0, 0.0], "a", 9), (2, [1.0, 0.1], "a", 8), (3, [1.0, 0.0], "b", 7), (4, [0.0, 1.0], "a", 6)]
    want = {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)}
    for kind, as_label in (("string", str), ("long", lambda x: 1 << 40 | ord(x)), ("double", lambda x: float(ord(x)))):
        df = spark.createDataFrame([(i, v, as_label(x), n) for i, v, x, n in rows], f"vec_id long, embedding array<double>, label {kind}, n_links long")
        assert set(map(tuple, embedding_dedup.near_vectors(df).collect())) == want


@pytest.mark.parametrize("per_label", [2_000, 20_000, 100_000])
def test_recall_of_keys_at_any_size(per_label):
    """Partners at cosine 0.93 to 0.97 that share a key of some table and lie within the radius, for production keys."""
    rng = np.random.default_rng(per_label)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.learn_rotation(unit(rng.standard_normal((4000, 64))), int(np.ceil(np.log2(per_label / embedding_dedup.BUCKET))), 0.93)
    a, u = unit(rng.standard_normal((5000, 64))), rng.standard_normal((5000, 64))
    c = rng.uniform(0.93, 0.97, (5000, 1))
    b = c * a + np.sqrt(1 - c**2) * unit(u - (u * a).sum(axis=1, keepdims=True) * a)
    x, y = (embedding_dedup._bits(v, model) for v in (a, b))
    met = (embedding_dedup.table_keys(x, model) == embedding_dedup.table_keys(y, model)).any(axis=1) & ((x != y).sum(axis=1) <= model["radius"])
    assert met.mean() >= 0.97

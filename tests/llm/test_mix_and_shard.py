from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import mixing, sharding


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def check(docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want, got, taken = targets(sizes), mixing.mix(docs).collect(), defaultdict(int)
    assert Counter((r["doc_id"], r["source"], words(r["text"])) for r in rows) == Counter((r["doc_id"], r["source"], r["size"]) for r in got)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    return want


def test_mix(spark, awkward):
    check(awkward)
    rows = [(k, "w " * (k % 50), "en", f"s{k % 7}" if k % 3 else "hot", 1) for k in range(400)]
    check(spark.createDataFrame(rows, awkward.select("doc_id", "text", "lang", "source", "n_chars").schema))


def test_mixed_rows(spark, awkward):
    rows = [(k, "w " * (k % 50 + 1), "en", f"s{k % 7}" if k % 3 else "hot", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, awkward.select("doc_id", "text", "lang", "source", "n_chars").schema)
    out, want = mixing.mixed_rows(docs).collect(), check(docs)
    took = defaultdict(int)
    for r in out:
        took[r["source"]] += words(r["text"])
    assert all(abs(took[s] - want[s]) <= 25 for s in want) and max(Counter(r["doc_id"] for r in out).values()) <= 2
    got = mixing.mixed_rows(awkward)
    assert got.columns == awkward.columns


def test_nothing_to_mix(spark, nothing):
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_rows(nothing).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None)], nothing.schema)
    assert mixing.mix(blank).first()["taken"] == 0


def test_matrix():
    for rows in ([5, 0, 7, 100], [1], [0], [], [3] * 40):
        matrix = sharding.communication_matrix(rows, 16, 1)
        assert [sum(x) for x in matrix] == rows
        columns = [sum(x) for x in zip(*matrix, strict=True)] or [0]
        assert max(columns) - min(columns) <= 1
    spread = [sharding.communication_matrix([50, 50], 2, s)[0][0] for s in range(400)]
    assert 24 < sum(spread) / 400 < 26 and 4 < sum((x - 25) ** 2 for x in spread) / 400 < 9  # hypergeometric: 6.3
    big = sharding.communication_matrix([3 * 10**9, 2 * 10**9], 4, 1)
    assert [sum(x) for x in big] == [3 * 10**9, 2 * 10**9] and [sum(x) for x in zip(*big, strict=True)] == [125 * 10**7] * 4


def test_shards(spark, awkward, nothing):
    for df in (awkward, awkward.withColumnRenamed("_row", "shard"), spark.range(1000).repartition(7)):
        out = sharding.assign_shards(df, 16).collect()
        assert len(out) == df.count()
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        counts = [len(slots[k]) for k in range(16)]
        assert max(counts) - min(counts) <= 1
    assert sharding.assign_shards(nothing).collect() == []


def test_shuffle_is_uniform(spark):
    hits = Counter()
    for seed in range(12):
        for r in sharding.assign_shards(spark.range(64).repartition(4), 4, seed).collect():
            hits[r["id"] // 16, r["shard"]] += 1
    assert all(abs(n - 48) < 25 for n in hits.values()) and len(hits) == 16


def test_draws_follow_the_hypergeometric_law():
    for good, bad, n in ((5, 7, 6), (40, 200, 100), (3, 0, 2), (0, 4, 3), (10, 10, 0)):
        rng = np.random.default_rng(good)
        got = Counter(sharding._draw(rng, good, bad, n) for _ in range(20_000))
        for k in range(0, n + 1):
            want = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(got[k] / 20_000 - want) < 0.015
    rng, good, bad, n = np.random.default_rng(1), 6 * 10**11, 94 * 10**11, 10**9  # far beyond what a table of counts could hold
    draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(300)])
    mean, deviation = n * good / (good + bad), math.sqrt(n * 0.06 * 0.94)
    assert abs(draws.mean() - mean) < 5 * deviation / math.sqrt(300) and 0.8 < draws.std() / deviation < 1.2


def test_matrix_has_exact_margins():
    rows = [0, 1, 17, 10**10 + 3, 250]
    matrix = sharding.communication_matrix(rows, 16, 5)
    assert [sum(line) for line in matrix] == rows
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(rows)


def test_shards_against_a_plain_shuffle(spark):
    """The same steps by plain loops: every partition permuted and dealt by its line, then every shard permuted."""
    rows = spark.range(0, 200, 1, 3)
    numbered = rows.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("r"), *(F.xxhash64(F.lit(20), F.lit(s), F.monotonically_increasing_id()).alias(s) for s in ("local", "shard"))).collect()
    parts = sorted({r["p"] for r in numbered})
    matrix = sharding.communication_matrix([sum(r["p"] == p for r in numbered) for p in parts], 16, 20)
    shard_of = {}
    for p, line in zip(parts, matrix, strict=True):
        mine = iter(sorted((r for r in numbered if r["p"] == p), key=lambda r: (r["local"], r["r"])))
        for j, n in enumerate(line):
            for _ in range(n):
                shard_of[next(mine)["id"]] = j
    want = set()
    for j in range(16):
        inside = sorted((r for r in numbered if shard_of[r["id"]] == j), key=lambda r: (r["shard"], r["r"]))
        want |= {(r["id"], j, slot) for slot, r in enumerate(inside)}
    assert {(r["id"], r["shard"], r["slot"]) for r in sharding.assign_shards(rows).collect()} == want

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, language_id, lm_score, queries
from sheaf.llm import words as W
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.01"


def test_hashed_words_are_words():
    texts = ["A b\tc  B", None, "", " x", "é É", "a" * 5000 + " a", "\n\n"]
    found, starts = W.hashed_words(texts, W.SPACED)
    for k, t in enumerate(texts):
        assert starts[k + 1] - starts[k] == len((t or "").encode().split())
    assert found[1] == found[3] and len({int(x) for x in found}) == len({w for t in texts for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()})
    whole, _ = W.hashed_words(["one two three one two"], W.ALNUM)
    apart, _ = W.hashed_words(["one, two! Three; ONE-two."], W.ALNUM, lower=True)
    assert (whole == apart).all() and W.shingles(whole, 2)[0] == W.shingles(whole, 2)[3]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the provided tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op6_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert sum(r["rejected"] for r in got) / len(got) < 0.02


def test_languages_of_awkward_documents(spark, awkward, nothing):
    labelled = spark.createDataFrame([(k, f"{a} " * 30, a) for k, a in enumerate(["der und nicht", "the and of"] * 30)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled, F.xxhash64("doc_id"))
    assert model["languages"] == ["der und nicht", "the and of"]
    rows = {r["_row"]: r for r in language_id.identify(awkward, model).collect()}
    assert len(rows) == awkward.count()
    for k in (2, 3, 4, 5, 11):
        assert (rows[f"x{k}"]["lang_pred"], rows[f"x{k}"]["score"], rows[f"x{k}"]["rejected"]) == ("und", 0.0, True)
    assert all(r["lang_pred"] != "und" and 0 <= r["score"] <= 1 for k, r in rows.items() if k not in ("x2", "x3", "x4", "x5", "x11"))
    text = labelled.limit(1).withColumn("score", F.lit("mine"))
    assert language_id.identify(text, model).first()["score"] > 0.9
    assert language_id.accepted(awkward, model).columns == awkward.columns
    assert language_id.fit(nothing, F.xxhash64("doc_id")) is None
    assert language_id.identify(awkward.limit(1), None).first()["lang_pred"] == "und" and language_id.identify(nothing, model).collect() == []


def test_nearest_centroid_by_plain_loops(spark):
    """Counts, weights and cosines of n-grams once more, one text and one byte at a time."""
    labelled = spark.createDataFrame([(k, f"{a} " * (5 + k % 7) + prose(k, 8), a[:3]) for k, a in enumerate(["der und nicht", "the and of", "que los para"] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled, F.xxhash64("doc_id"))

    def counts(text):
        raw, out = b" " + text.lower().encode() + b" ", Counter()
        kept = []
        for b in raw:
            b = b if 97 <= b <= 122 or b >= 128 else 32
            if b != 32 or not kept or kept[-1] != 32:
                kept.append(b)
        for n in (1, 2, 3):
            for k in range(len(kept) - n + 1):
                gram = 0
                for b in kept[k : k + n]:
                    gram = (gram * 0x01000193 + b + 1) % 2**32
                out[(gram * 0x9E3779B1 % 2**32 >> 20) % language_id.FEATURES] += 1
        return out

    texts = ["the and of the", "der und nicht und", "que los para que los", "x", "THE AND. of!", prose(3, 40), "und the que"]
    got = language_id.predict(texts, model)
    for text, lang, score in zip(texts, got[0], got[1], strict=True):
        weighed = {f: math.log1p(n) * float(model["idf"][f]) for f, n in counts(text).items()}
        norm = math.sqrt(sum(w * w for w in weighed.values()))
        cosines = [sum(w * float(c[f]) for f, w in weighed.items()) / norm for c in model["centroids"]]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert score == pytest.approx(min(1.0, max(0.0, cosines[best])), abs=1e-4) and lang == model["languages"][model["owner"][best]]


def test_far_texts_are_rejected(spark):
    labelled = spark.createDataFrame([(k, prose(k, 60 + k), "xx") for k in range(200)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled, F.xxhash64("doc_id"))
    odd = spark.createDataFrame([(1, "qqq zzzw xjxj " * 40, None), (2, prose(999, 100), None)], labelled.schema)
    assert [r["rejected"] for r in language_id.identify(odd, model).orderBy("doc_id").collect()] == [True, False]


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def test_base_scores_and_both_paths(spark, awkward, monkeypatch):
    extra = spark.createDataFrame([(100 + k, prose(k % 20, 200), None, None, None, "") for k in range(60)], awkward.schema)
    docs = awkward.union(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(x)), sum(t in counts for t in tokens(x)), round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 4)) for i, x in rows)
    remainder = queries._remainder(5) == 1
    ours = [tuple(r) for r in lm_score.train_and_score(docs, remainder).collect()]
    assert sorted((str(r[0]), r[2], r[3], round(r[5], 4)) for r in ours) == want
    assert {r[4] for r in ours} == {n} and all(r[1] == held(r[0]) for r in ours)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 20_000)
    ours = [tuple(r) for r in lm_score.train_and_score(docs, remainder).collect()]
    monkeypatch.setattr(lm_score, "BROADCAST_BYTES", -1)
    other = [tuple(r) for r in lm_score.train_and_score(docs, remainder).collect()]
    assert sorted((str(r[0]), r[2], r[3], round(r[5], 4)) for r in other) == want
    for a, b in zip(sorted(ours, key=repr), sorted(other, key=repr), strict=True):
        assert a[6] == pytest.approx(b[6], rel=1e-12)  # one filter, sent whole or asked by buckets


def test_empty_training(spark, nothing, awkward):
    assert lm_score.train_and_score(nothing, F.lit(False)).collect() == []
    got = lm_score.train_and_score(awkward, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)


def test_filter_never_reads_low():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.2, len(hashes))
    body = lm_score._filter(hashes, counts)
    bits, size = np.frombuffer(body, np.uint8), np.full(len(hashes), 8 * len(body), np.uint64)
    got = lm_score._probed(hashes, bits, np.zeros(len(hashes), np.int64), size)
    want = lm_score.levels_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.03
    assert (lm_score.levels_of(np.array([1, 2, 3, 4, 7, 8])) == [1, 2, 2, 3, 3, 4]).all()
    absent = rng.integers(1 << 62, 1 << 63, 20_000, dtype=np.uint64)
    assert (lm_score._probed(absent, bits, np.zeros(len(absent), np.int64), np.full(len(absent), 8 * len(body), np.uint64)) > 0).mean() < 0.03


def test_scores_by_plain_loops(spark):
    """The whole model once more with dictionaries: scores agree, and probabilities behind each history sum to one."""
    rows = [(k, " ".join(prose(k % 9, 12 + k % 5).split() * (1 + k % 3))) for k in range(60)] + [(100, "a b a c a b a c"), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.train_and_score(docs, F.col("doc_id") % 5 == 1).collect()}
    cut = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]
    train = [cut(t) for k, t in rows if k % 5 != 1]
    singles, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["^", *t], t, strict=False))
    hash_of = {w: np.uint64(lm_score.tokens([w])[0][0]) for w in singles if w} | {None: lm_score.END, "^": lm_score.START}
    joint = {p: lm_score.W.mix(np.array([hash_of[p[0]] * np.uint64(lm_score.W.BASE) + hash_of[p[1]]]))[0] for p in pairs}
    held = {p: int(lm_score.rounded(np.array([joint[p]]), np.array([n]))[0]) for p, n in pairs.items()}
    assert all(n / 2 < held[p] < 2 * n and (held[p] == n or n & (n - 1)) for p, n in pairs.items()) and sum(held.values()) == pytest.approx(sum(pairs.values()), rel=0.05)
    v, n, count = len(singles), sum(singles.values()), {**singles, "^": len(train)}
    noise = lm_score.READ_ABSENT * (v + 1)

    def p(h, w):
        alone, first = (singles[w] + 0.5) / (n + 0.5 * (v + 1)), count.get(h, 0)
        left = 1 - lm_score.BIGRAM_WEIGHT * (lm_score.READ_HELD * first + noise) / (first + noise)
        return lm_score.BIGRAM_WEIGHT * held.get((h, w), 0) / (first + noise) + left * alone if first else alone

    close = 0
    for k, t in rows:
        want = sum(math.log10(p(h, w)) for h, w in zip(["^", *cut(t)], cut(t), strict=False))
        assert got[k]["n_tokens"] == len(cut(t)) and got[k]["score"] == pytest.approx(want, rel=0.15, abs=0.3)  # false levels aside
        close += abs(got[k]["score"] - want) < 1e-6
    assert close > len(rows) / 2
    rng, words = np.random.default_rng(9), np.unique(np.random.default_rng(8).integers(0, 1 << 62, 2000, dtype=np.uint64))
    counts = np.zeros(2001)  # behind one history, of all words and the unknown one
    counts[rng.choice(2000, 30, replace=False)] = rng.geometric(0.3, 30)
    held = np.flatnonzero(counts)
    body = lm_score._filter(W.mix(words[held]), lm_score.rounded(words[held], counts[held].astype(np.int64)))
    read = lm_score._probed(W.mix(np.append(words, np.uint64(5))), np.frombuffer(body, np.uint8), np.zeros(2001, np.int64), np.full(2001, 8 * len(body), np.uint64))
    alone = np.full(2001, 1 / 2001)
    total = lm_score.probability(alone, lm_score._LEVEL_COUNTS[read], np.full(2001, int(counts.sum())), 2000).sum()
    assert total == pytest.approx(1, abs=0.1)


def test_bigrams_raise_seen_texts(spark):
    rows = [(k, prose(k, 100)) for k in range(40)]
    got = lm_score.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 30).collect()
    per = lambda r: r["score"] / r["n_tokens"]
    assert min(per(r) for r in got if not r["held_out"]) > max(per(r) for r in got if r["held_out"])


def found_by_brute_force(docs, items):
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    kinds = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            k = min(5, len(w))
            kinds[i] = (len(w), k, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
    held_by = Counter(s for _, _, own in kinds.values() for s in own)
    out = set()
    for row, (_, t) in enumerate(docs):
        w = split(t)
        for i, (n, k, own) in kinds.items():
            weight = {s: math.log(1 + len(kinds) / held_by[s]) for s in own}
            n = min(n, len(w))  # a shorter text is one window
            for a in range(len(w) - n + 1):
                window = {tuple(w[b : b + k]) for b in range(a, a + n - k + 1)}
                if sum(weight[s] for s in own & window) >= 0.8 * sum(weight.values()) - 1e-9:
                    out.add((row, i))
                    break
    return out


def test_windows_against_brute_force(spark, monkeypatch):
    items = [(k, prose(5000 + k, 20 + 7 * k)) for k in range(12)] + [(50, "tiny one"), (51, ""), (52, None), (None, "null id here"), (53, prose(5000, 20) + " tail of it"), (54, "two words")]
    docs = []
    for k in range(60):
        item = items[k % 12][1].split(" ")
        for _ in range(k % 4):
            item[(k * 7) % len(item)] = "other"
        docs.append((k, prose(k, 40) + " " + " ".join(item[: len(item) - (k % 5)]).upper() + ", " + prose(900 + k, 30)))
    docs += [(100, None), (101, ""), (102, "a TINY, one"), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, prose(77, 20_000) + items[3][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter((docs[row][0], i) for row, i in found_by_brute_force(docs, items))
    for size in (decontaminate.BLOCK_BYTES, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect())
        assert got == want
        kept = decontaminate.without_contaminated(frame, bench).collect()
        assert Counter(r["doc_id"] for r in kept) == Counter(d for d, _ in docs) - Counter({d: sum(x == d for x, _ in docs) for d, _ in got})
    assert len(want) > 30


def test_awkward_contamination(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, prose(1, 120)), (1, prose(1, 120)), (2, "12345 678")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(awkward, bench).collect()}
    assert got == {(1, 1), (8, 1), (6, 2)}
    assert decontaminate.contaminated(awkward, bench.limit(0)).collect() == [] and decontaminate.contaminated(nothing, bench).collect() == []
    assert decontaminate.without_contaminated(awkward, bench).columns == awkward.columns

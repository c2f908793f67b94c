from __future__ import annotations

import random
import re
import time

import duckdb
import pytest

from sheaf.llm import line_dedup, queries


def distance_at_most_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def brute(lines, least=0):
    """lines: (doc_id, line_no, normalised), in any order."""
    first = {}
    for d, n, s in sorted(lines):
        first.setdefault(s, (d, n))
    out = {}
    for d, n, s in lines:
        near = [p for t, p in first.items() if min(len(t), len(s)) >= least and t != s and p < first[s] and distance_at_most_one(s, t)]
        out[d, n] = (min(near), 1) if near else (first[s], 0) if first[s] < (d, n) else (None, None)
    return out


def made(spark, seed=3, docs=60):
    rng, base = random.Random(seed), []
    for _ in range(40):
        base.append("".join(rng.choice("ab c") for _ in range(rng.choice((1, 2, 3, 8, 11, 12, 13, 15, 16, 17, 31, 32, 33, 48)))))
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(8):
            s = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.choice((0, 1))] = rng.choice(("", "a", "z"))
            lines.append("".join(s))
        rows.append((d, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("least", [0, 12])
def test_against_all_pairs(spark, least):
    df, rows = made(spark)
    lines = [(d, n, re.sub(" +", " ", x).strip(" ")) for d, t in rows for n, x in enumerate(t.split("\n"))]
    want = brute([x for x in lines if x[2]], least)
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"], r["edits"], r["kept"]) for r in line_dedup.near_lines(df, least).collect()}
    assert set(got) == set(want)
    for key, (first, edits) in want.items():
        assert got[key] == ((*first, edits, False) if first else (None, None, None, True)), key
    assert sum(e == 1 for _, e in want.values()) > 30


def test_against_its_sql(spark):
    df, _ = made(spark, seed=4, docs=20)
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    want = sorted(map(repr, con.sql(f"SELECT doc_id, line_no, kept, first_doc_id, first_line_no, edits FROM ({queries.ORACLES['op1_near_lines']})").fetchall()))
    got = sorted(repr(tuple(r)) for r in line_dedup.near_lines(df).select("doc_id", "line_no", "kept", "first_doc_id", "first_line_no", "edits").collect())
    assert got == want


def test_shuffled_when_not_small(spark, monkeypatch):
    df, _ = made(spark, seed=5, docs=15)
    want = sorted(map(repr, line_dedup.near_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, line_dedup.near_lines(df).collect())) == want


def test_awkward_documents(spark, awkward, nothing):
    rows = line_dedup.near_lines(awkward).collect()
    assert {r["doc_id"] for r in rows} >= {1, 2, 6, 7, 8, 9, None} and not {3, 4, 5} & {r["doc_id"] for r in rows}
    assert [r["kept"] for r in rows if r["doc_id"] == 8] == [False]
    cut = line_dedup.without_near_lines(awkward)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()
    assert cut.where("doc_id = 8").first()["text"] == "" and cut.where("doc_id = 3").first()["text"] is None
    assert line_dedup.near_lines(nothing).collect() == []


def test_kept_lines_stay_in_order(spark):
    df = spark.createDataFrame([(1, "a line of words\n\nB"), (2, "first here now\nA  line of Words\n\nlast one here")], "doc_id long, text string")
    assert line_dedup.without_near_lines(df).where("doc_id = 2").first()["text"] == "first here now\n\nlast one here"


def test_long_near_lines(spark):
    """Two pairs of lines of a million characters, one edit apart, and one pair two edits apart."""
    rng = random.Random(1)
    letters = [chr(c) for c in range(97, 123)] + ["é", "\U0001f600"]
    whole = "".join(rng.choices(letters, k=1_000_000))
    other = "".join(rng.choices(letters, k=1_000_000))
    rows = [(1, whole), (2, whole[:777_777] + "#" + whole[777_778:]), (3, other), (4, other[:123_456] + other[123_457:]), (5, other[:5] + "#" + other[6:900_000] + "#" + other[900_001:])]
    began = time.monotonic()
    got = {r["doc_id"]: (r["first_doc_id"], r["edits"]) for r in line_dedup.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, None), 2: (1, 1), 3: (None, None), 4: (3, 1), 5: (None, None)} and time.monotonic() - began < 60


def test_one_edit_apart(spark):
    rng = random.Random(2)
    rows = []
    for n in (1, 2, 15, 16, 17, 18, 31, 32, 33, 49):
        for _ in range(60):
            a = [rng.choice("ab") for _ in range(n)]
            b = list(a)
            for _ in range(rng.choice((1, 1, 2))):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.choice((0, 1))] = rng.choice(("", "a", "c"))
            if a != b and b:
                rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", line_dedup._one_edit_apart(df["a"], df["b"]).alias("near")).collect():
        assert r["near"] == distance_at_most_one(r["a"], r["b"]), r


def test_no_python_in_the_plan(spark, awkward):
    plan = line_dedup.near_lines(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""MinHash labels against the SQL on awkward names, by either join, and without work for each copy of a text."""

from __future__ import annotations

import duckdb
import pytest

from sheaf.plans import catalogue
from sheaf.sources import scratch
from tests.test_policy import most_joined

NAMES = [None, "", "  ", "--", "a", "ab", "a b", "A-B_c", "steel ring", "Steel  Ring!", "steelring", "ring", "𠀀𠀁𠀂𠀃", "𠀀 𠀁🙂𠀂", "大钢环", "large steel bolt", "x" * 3000, "bolt 7"]
TYPES = ["", None, "LARGE", "large!", "steel ring", "Ring", " ring ", "𠀁𠀂𠀃", "--", "bolt", "BOLT-7", "a"]


def written_parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("types", [TYPES, [None, " "]])
@pytest.mark.parametrize("limit", [scratch.BROADCAST_BYTES, -1])
def test_labels_match_the_sql(spark, tmp_path, monkeypatch, limit, types):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", limit)
    where = written_parts(spark, tmp_path, [(k, NAMES[k % len(NAMES)], types[k * 7 % len(types)]) for k in range(90)])
    got = sorted(map(tuple, catalogue.QUERIES["minhash_label_match"](spark, where).select("p_partkey", "label", "agree").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{where}/part.parquet/*.parquet'")
    want = con.sql(f"SELECT p_partkey, label, agree FROM ({catalogue.ORACLES['minhash_label_match'].strip()}) ORDER BY 1").fetchall()
    assert got == want and len(got) == 75


def test_copies_of_a_text_are_signed_once(spark, tmp_path):
    where = written_parts(spark, tmp_path, [(k, ("steel ring", "Steel-Ring", "large bolt")[k % 3], ("steel ring", "bolt")[k % 2]) for k in range(3000)])
    told = catalogue.QUERIES["minhash_label_match"](spark, where)
    assert {(r["p_partkey"] % 3, r["label"]) for r in told.collect()} == {(0, "steel ring"), (1, "steel ring"), (2, "bolt")}
    assert 3000 <= most_joined(told._jdf.queryExecution().executedPlan()) <= 3000 + 4 * 64  # one row a text, and 64 minima of 2 texts with 2 labels

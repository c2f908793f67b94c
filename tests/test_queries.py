"""Every registered query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from sheaf.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the provided tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 8)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert df.columns
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    relation = duck.sql(catalogue.ORACLES[name])
    assert sorted(relation.columns) == columns
    want = sorted(repr([plain(v) for v in row]) for row in duck.sql(f"SELECT {listed} FROM ({catalogue.ORACLES[name].strip()})").fetchall())
    assert got == want

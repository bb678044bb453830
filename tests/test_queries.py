import os

import duckdb
import pytest

import __spark_entry__ as entry
from drawlens.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def text(v):
    if v is None or v != v:
        return "-"
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in core.ORACLES])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(text(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1

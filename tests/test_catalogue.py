"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from ledgerlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) + 0.0 if isinstance(v, float) else v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0

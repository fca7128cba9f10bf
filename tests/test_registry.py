"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from clausemill.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows or name == "rules_never_found"
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_flagship():
    assert FLAGSHIP in QUERIES

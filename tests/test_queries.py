"""Every core query against its SQL, at the smallest scale."""

import duckdb
import pytest

from driftwell import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(str(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.SQL[name])
    names, want = [x[0] for x in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)

"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from assetloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    got = rows(plans.QUERIES[name](spark, SF).toPandas())
    assert got == rows(duck.execute(plans.SQL[name]).df())
    assert got[1]


def test_every_query_has_sql():
    assert set(plans.SQL) == set(plans.QUERIES)

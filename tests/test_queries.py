"""Every registered query with SQL gives the rows that DuckDB gives; every other query runs."""

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, (float, np.floating)):
            return f"{v:.6f}"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return str(v).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows_of(got) == rows_of(duck.execute(sql).df())
    else:
        assert len(got.columns) > 1


def test_flagship(spark):
    assert catalog.flagship(spark, SF, min_symbols=3).count() > 0

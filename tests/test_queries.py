"""Every registered mesh query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lattica import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df):
    columns = sorted(df.columns)
    df = df[columns].apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) else c)
    return df.sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=1e-6, atol=2e-3)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

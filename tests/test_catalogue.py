"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from strataforge.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    cells = lambda r: tuple("null" if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) and x == int(x) else x for x in r)
    return sorted(map(cells, df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Rows of the queries without SQL; what is in them is tested in test_operators.
WITHOUT_SQL = {"diff_text": 121, "html_text": 50, "fuzzy_files": 20}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_its_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() == WITHOUT_SQL[name]

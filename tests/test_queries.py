"""Each registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from lodeframe import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    mine, other = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    key = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert key(mine.astype(str)) == key(other.astype(str))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())

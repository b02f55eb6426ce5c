"""Queries against their SQL in DuckDB at sf0.001."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, name, queries, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries[name](spark, sf).toPandas(), con.sql(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)  # a query that finds nothing proves nothing
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).replace({"nan": "None", "<NA>": "None"}).to_numpy().tolist()))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.SQL:
        same(spark, name, catalogue.QUERIES, catalogue.SQL)
    else:
        assert catalogue.QUERIES[name](spark, SF).schema is not None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_reports_are_fewer_than_users(spark):
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert 1 <= catalogue.scan_reports(spark, SF).count() <= users // catalogue.RUNS + 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import SF
from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SLOW = {"kmeans_sweep", "rfe_svc", "permutation_importance"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def table_of(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    frame = queries()[name](spark, SF)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert table_of(frame.columns, frame.collect()) == table_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0

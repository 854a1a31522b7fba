"""Every catalogued query against its SQL on DuckDB, and the entry points."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tessera import queries as catalogue


def normal(value):
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, (int, str, type(None))) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    expected = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == table(names, expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.queries()["index_only_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,100)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_join_strategies_are_followed(spark, sf_dir):
    plans = {n: catalogue.queries()[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString() for n in ("hash_join_hint", "merge_join_hint")}
    assert "ShuffledHashJoin" in plans["hash_join_hint"]
    assert "SortMergeJoin" in plans["merge_join_hint"]

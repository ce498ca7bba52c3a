"""Every registered query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathlens.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    from pathlens.operators import search
    from pathlens.plans.fixtures import entries

    entries(spark, sf_dir, "fx1").write.parquet(f"{tmp_path}/e")
    plan = search.hits(spark.read.parquet(f"{tmp_path}/e"), "europe order").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(path_fold,europe)" in plan and "name_fold" not in plan.split("ReadSchema")[1]

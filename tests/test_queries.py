"""Every registered query of the linkage side against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from matchloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        rows[c] = rows[c].map(lambda x: None if x is None else str(x)) if rows[c].dtype == object else rows[c].astype(float).round(8)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_same_as_sql(spark, duck, name):
    mine = Q.QUERIES[name](spark, SF)
    result = duck.execute(Q.ORACLE[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in mine.dtypes} == kinds
    pd.testing.assert_frame_equal(canonical(mine.toPandas()), canonical(result.df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_columns_and_filters_reach_the_scan(spark):
    plan = Q.QUERIES["source_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan
    plan = Q.QUERIES["lookup_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(o_orderpriority,1-)" in plan and "o_totalprice" not in plan


def test_cosine_joins_on_keys(spark):
    plan = Q.QUERIES["merged_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

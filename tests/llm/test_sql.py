"""Queries of the training-data operators against their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from matchloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_same_as_sql(spark, duck, name):
    mine = Q.QUERIES[name](spark, SF)
    result = duck.execute(Q.ORACLE[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(mine.columns) == columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in mine.dtypes} == {d[0]: str(d[1]) for d in result.description}
    theirs = result.df()[columns]
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(theirs.itertuples(index=False, name=None))

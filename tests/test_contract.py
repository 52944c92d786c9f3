"""Every contract query against its SQL in DuckDB, on whole tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import contract, contract_benchmarks, contract_docx, contract_more, contract_records, contract_selection, contract_store, contract_transactions  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def shown(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 6)) if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(shown(x) for x in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(contract.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = contract.QUERIES[name](spark, SF).toPandas(), duck.sql(contract.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLE)))
def test_other_queries_run(spark, name):
    """Queries without SQL are held against brute force elsewhere; here they must give rows of their schema."""
    got = contract.QUERIES[name](spark, SF)
    assert got.columns and got.count() > 0

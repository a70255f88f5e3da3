"""Queries against their SQL twins on the smallest table."""

import duckdb
import pytest

from probatio.llm import queries

from llm_helpers import SF

REGISTRY = queries.registry()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_twin(spark, duck, name):
    run, sql = REGISTRY[name]
    found = run(spark, SF).toPandas()
    wanted = duck.sql(sql).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = columns
    left = found[columns].sort_values(key).astype(str).reset_index(drop=True)
    right = wanted[columns].sort_values(key).astype(str).reset_index(drop=True)
    assert len(left) and left.equals(right)


def test_a_query_for_each_operator():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{k}" for k in range(1, 14)}

"""Every query over the smallest tables, and against DuckDB where there is SQL for it."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from archgraph.plans.oracles import oracle_sql
from archgraph.plans.queries import queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, SMALL)
    got = sorted(tuple(str(r[c]) for c in sorted(found.columns)) for r in found.collect())
    if name in oracle_sql():
        rel = duck.sql(oracle_sql()[name])
        order = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(found.columns) == sorted(rel.columns)
        assert got == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

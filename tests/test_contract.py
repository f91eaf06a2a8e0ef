"""Every registered query against its DuckDB statement, on the smallest test tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from logloom import contract, oracle
from tools.check_contract import TABLES, digest

SF = os.environ.get("LOGLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(SF) / f"{t}.parquet"
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(contract.queries()) == set(oracle.oracle_sql())
    assert set(contract.queries()) <= set(E.queries()) and set(oracle.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_oracle(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(oracle.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, orows)[0]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["level", "logger", "message", "error_count", "latest_occurrence", "first_occurrence"]
    assert df.count() > 0


def test_clean_up_removes_what_the_queries_made(spark):
    """Run last: no database, view or folder of the queries above is left."""
    contract.sql_script(spark, SF)
    contract.simple_logs(spark, SF).collect()
    folders = [Path(f.removeprefix("file:")) for f in contract._FOLDERS]
    assert folders and any(f.exists() for f in folders)
    contract.clean_up(spark)
    assert not any(f.exists() for f in folders)
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("logloom_")]
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(("logs_", "errors_"))]


def test_plans_do_not_depend_on_the_cluster(spark):
    """No shuffle of the rows below the aggregation: the only exchange of the count is its single row."""
    plan = contract.queries()["total_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and plan.count("Exchange") <= 1

"""The driver's contract, and a few queries checked against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from shotmetrics.catalog import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CHECKED = ["zone_season", "monthly_trends", "upsert_new_rows", "resolve_names", "sensitivity", "drift_rows"]


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    yield con
    con.close()


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    without = set(QUERIES) - set(ORACLES)
    assert without == {"score_logistic", "score_boosted", "model_metrics", "propensity_scores"}


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 34
    assert "rolling_2season_xfg" in rows[0].asDict()


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, small_dir, duck, name):
    frame = contract.queries()[name](spark, small_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want

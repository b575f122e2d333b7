"""Every registered query with a SQL check against DuckDB on the smallest tables; the rest must run."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from wardlake import plans

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check_queries import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
# minutes of model fitting; tests/test_models.py runs the same code with small estimators
SLOW = {"train_risk_models", "cross_validate", "risk_scores", "what_if_scores"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - SLOW))
def test_query(spark, duck, name):
    _, rows, verdict = compare(spark, duck, name, SF)
    assert verdict in ("ok", "rows-only")
    if verdict == "rows-only":
        assert rows > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

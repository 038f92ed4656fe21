"""Every registered query against its SQL, and what their plans must not contain."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from martwright.catalogue import ORACLES, QUERIES
from martwright.catalogue.base import TABLES
from tools.check_oracle import compare

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    verdict, _, _ = compare(spark, con, key, str(FOLDER))
    assert verdict == "ok"


@pytest.mark.parametrize("key", ["mart", "calls_last_minute", "norm_provider", "pii_scrub", "scorecard", "profile_columns", "latest_non_null",
                                 "external_measure", "keyword_overlap", "keyword_topk", "valid_measures", "drift_columns", "histogram_orders"])
def test_plan_has_no_python_no_cross_join(spark, key):
    plan = contract.queries()[key](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scan_reads_only_what_it_needs(spark):
    plan = contract.queries()["scan_parquet"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan


def test_top_values_rank_below_the_shuffle(spark):
    plan = contract.queries()["top_values"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and QUERIES.items() <= contract.queries().items()


def test_entry(spark):
    assert contract.entry(spark).count() == 25

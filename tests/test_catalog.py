"""The registry: every key runs, and quick ones equal the checking SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from passbook import catalog
from passbook.catalog.registry import Tables

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "agg_category agg_metrics agg_trend_custom agg_insights agg_dashboard filter_search filter_all category_lookup money_format "
    "job_dedup job_stage set_bulk_confirm win_echo source_path_check sink_csv stream_ledger_aggs stream_echo win_voronoi"
).split()


def test_entry(spark):
    assert entry.entry(spark).columns == ["category_id", "category_name", "total", "percentage", "count"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", QUICK)
def test_equals_sql(spark, con, key):
    assert compare(entry.queries()[key](spark, FOLDER), con, entry.oracle_sql()[key]) is None


def test_numbered_rows_are_worked_out_once(spark):
    """Views that name the numbered order lines several times read them from one written table."""
    tables = Tables(spark, FOLDER)
    for view in (tables.tokens, tables.lines, tables.detections):
        assert "Window" not in view._jdf.queryExecution().optimizedPlan().toString()
    assert sum("written" in k for k in tables._views) == 1

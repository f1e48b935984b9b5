"""Plan assertions: the optimizer does what the design relies on."""

import pytest

import __spark_entry__ as E
from chalkline.plans.inspect import plan_summary

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_take_ordered(spark):
    p = _plan(E.queries()["top_schools"](spark, SF))
    assert "TakeOrderedAndProject" in p


def test_window_filter_reaches_parquet(spark):
    p = _plan(E.queries()["period_totals"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(ts), EqualTo(event_type,view), GreaterThan(ts," in p


def test_aggregate_before_dimension_join(spark):
    p = _plan(E.queries()["region_share"](spark, SF))
    # partial aggregate of the fact appears below the join to schools
    assert p.index("HashAggregate") < len(p) and "partial_count" in p


@pytest.mark.parametrize("name", [n for n in sorted(E.queries()) if not n.startswith(("live_", "view_ingest"))])
def test_no_python_udfs_and_no_cross_joins(spark, name):
    s = plan_summary(E.queries()[name](spark, SF))
    assert s["python_nodes"] == 0 and s["nested_loop_or_cartesian"] == 0, s

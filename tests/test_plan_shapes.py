"""Regression guard on the planned shape of the headline queries.

The counts are the design, not incidental: facts are filtered and partially
aggregated before one shuffle, dimensions are joined after the aggregate,
top-k never sorts globally. A change that adds shuffles here should be a
conscious one.
"""

import datetime as dt

import pytest

import __spark_entry__ as E
from chalkline.operators import changes as C
from chalkline.plans.inspect import plan_summary
from chalkline.session import shuffle_partitions_for
from tests import helpers as H

SF = "/root/testdata/sf0.01"

MAX_SHUFFLES = {
    "period_totals": 2, "daily_activity": 2, "top_schools": 1, "top_teachers": 1, "region_share": 2,
    "dashboard_counts": 1, "monthly_growth": 2, "recent_requests": 0, "school_request_feed": 1,
    "top_teachers_lineitem_all": 1, "expire_subscriptions": 0, "entitlement_report": 0, "view_log": 1,
}


@pytest.mark.parametrize("name", sorted(MAX_SHUFFLES))
def test_shuffle_budget(spark, name):
    s = plan_summary(E.queries()[name](spark, SF))
    assert s["shuffles"] <= MAX_SHUFFLES[name], s
    assert s["scans"] == s["pushed_filter_scans"] or name in ("dashboard_counts", "view_log", "teacher_export")


@pytest.mark.parametrize("name", ["top_schools", "top_teachers", "region_share", "recent_requests"])
def test_top_k_without_global_sort(spark, name):
    s = plan_summary(E.queries()[name](spark, SF))
    assert s["top_k"] and "SortMergeJoin" not in s["joins"]


def test_fact_counts_aggregate_partially(spark):
    for name in ("period_totals", "daily_activity", "top_schools", "region_share", "constraint_report"):
        assert plan_summary(E.queries()[name](spark, SF))["partial_aggregates"] >= 1, name


def test_shuffle_partition_sizing():
    assert shuffle_partitions_for(10 * 2**20) == 200
    assert shuffle_partitions_for(100 * 2**40) == 409_600
    assert shuffle_partitions_for(1 * 2**40) == 4096


def _sorts_by_stage(df):
    """Sorts in each stage of the plan (its parts between exchanges)."""
    counts = []

    def walk(node, stage):
        name = node.nodeName()
        if "Exchange" in name:
            counts.append(0)
            stage = len(counts) - 1
        counts[stage] += name == "Sort"
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), stage)

    counts.append(0)
    walk(df._jdf.queryExecution().executedPlan(), 0)
    return counts


@pytest.mark.parametrize("job", [C.changed_requests, C.apply_request_events])
def test_request_events_hold_few_sorts_in_a_task(spark, monkeypatch, job):
    """Every step of M10 meets on the request id; in one stage, a task held the sorts of all its joins at once."""
    plans = []

    def stored(df, path):
        plans.append(_sorts_by_stage(df))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(C, "_stored", stored, raising=False)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    at = dt.datetime(2024, 1, 2)
    feed = spark.createDataFrame(
        [(1, "create", 5, 1, 7, None, "", None, at), (2, "create", 5, 1, 7, None, "", None, at),
         (3, "close", 5, 1, 7, None, None, None, at), (4, "set_status", 2, None, None, "CLOSED", None, "n", at),
         (5, "set_status", 9, None, None, "CLOSED", None, None, at), (6, "create", 2, 1, 7, None, "", None, at)],
        "seq long, kind string, request_id long, teacher_id long, school_id long, status string, message string, "
        "admin_notes string, ts timestamp_ntz")
    requests = H.requests(spark, [{"id": i, "teacher_id": 1, "school_id": 7} for i in (1, 2, 2)])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        new, rejects = job(requests, feed, None, H.teachers(spark, [{"id": 1}]), H.schools(spark, [{"id": 7}]))
        plans += [_sorts_by_stage(new), _sorts_by_stage(rejects)]
        got = sorted((r.id, r.status, r.admin_notes) for r in new.filter("id != 1").collect())
        refused = sorted((r.seq, r.reason) for r in rejects.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(2, "CLOSED", "n"), (2, "CLOSED", "n"), (5, "CLOSED", None)]
    assert refused == [(2, C.DUPLICATE_REQUEST), (5, C.REQUEST_NOT_FOUND), *[(6, C.DUPLICATE_REQUEST)] * 2]
    assert max(n for plan in plans for n in plan) <= 3, plans

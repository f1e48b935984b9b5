"""Edge cases for the dashboard queries (FIXTURES §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chalkline.operators import analytics as A
from chalkline.sources import tables as TB
from tests import helpers as H

AS_OF = H.AS_OF
LO = AS_OF - dt.timedelta(days=7)


def test_window_boundary_is_strict_and_open_ended(spark):
    v = H.views(spark, [
        {"teacher_id": 1, "school_id": 1, "viewed_at": LO},                                   # excluded
        {"teacher_id": 1, "school_id": 2, "viewed_at": LO + dt.timedelta(microseconds=1)},    # kept
        {"teacher_id": 1, "school_id": 3, "viewed_at": AS_OF + dt.timedelta(days=3)},         # future: kept
    ])
    r = H.requests(spark, [])
    row = A.period_totals(v, r, AS_OF).first()
    assert (row.views, row.requests, row.active_schools) == (2, 0, 2)
    days = {x.full_date: x.views for x in A.daily_activity(v, r, AS_OF).collect()}
    assert len(days) == 8
    assert days["2024-01-24"] == 1 and sum(days.values()) == 1  # the future view has no spine day


@pytest.mark.parametrize("token,n", [("24h", 2), ("7d", 8), ("30d", 31), ("90d", 91), ("bogus", 8), (None, 8)])
def test_spine_lengths(spark, token, n):
    v, r = H.views(spark, []), H.requests(spark, [])
    out = A.daily_activity(v, r, AS_OF, token).collect()
    assert len(out) == n
    assert out[-1].full_date == "2024-01-31" and all(x.views == 0 and x.requests == 0 for x in out)
    assert out[-1].name == "Wed"


def test_conversion_zero_views_and_rounding(spark):
    r = H.requests(spark, [{"teacher_id": 1, "school_id": 1, "requested_at": AS_OF}])
    assert A.period_totals(H.views(spark, []), r, AS_OF).first().conversion == 0.0
    v = H.views(spark, [{"teacher_id": 1, "school_id": 1, "viewed_at": AS_OF}] * 2000)
    r = H.requests(spark, [{"teacher_id": 1, "school_id": 1, "requested_at": AS_OF}] * 63)
    # documented deviation: decimal half-up rounding gives 3.2 where JS toFixed gives 3.1
    assert A.period_totals(v, r, AS_OF).first().conversion == 3.2


def test_top_schools_ties_duplicate_names_and_orphans(spark):
    s = H.schools(spark, [{"id": i, "name": "Same" if i in (1, 2) else f"S{i}", "country": "X"} for i in range(1, 8)])
    rows = []
    for sid, n in [(1, 3), (2, 3), (3, 2), (4, 2), (5, 2), (6, 2), (99, 10)]:
        rows += [{"teacher_id": 1, "school_id": sid, "viewed_at": AS_OF}] * n
    out = A.top_schools(H.views(spark, rows), s, AS_OF).collect()
    assert [(x.school_id, x.views) for x in out] == [(1, 3), (2, 3), (3, 2), (4, 2), (5, 2)]
    assert [x.name for x in out[:2]] == ["Same", "Same"]


def test_region_share_labels(spark):
    s = H.schools(spark, [
        {"id": 1, "region": None, "country": "France"},
        {"id": 2, "region": None, "country": None},
        {"id": 3, "region": "", "country": "Spain"},
        {"id": 4, "region": "EU", "country": "Italy"},
    ])
    rows = [{"teacher_id": 1, "school_id": i, "viewed_at": AS_OF} for i in (1, 1, 2, 3, 4, 4, 4)]
    out = A.region_share(H.views(spark, rows), s, AS_OF).collect()
    assert [(x.name, x.value, x.color) for x in out] == [
        ("EU", 3, "#3b82f6"), ("France", 2, "#10b981"), ("", 1, "#f59e0b"), ("Other", 1, "#64748b")]


def test_monthly_growth_omits_empty_months(spark):
    t = H.teachers(spark, [{"id": 1, "created_at": dt.datetime(2023, 8, 5)},
                           {"id": 2, "created_at": dt.datetime(2024, 1, 2)},
                           {"id": 3, "created_at": dt.datetime(2023, 7, 31)}])   # not after as_of - 6 months
    s = H.schools(spark, [{"id": 1, "created_at": dt.datetime(2023, 8, 20)}])
    out = A.monthly_growth(t, s, AS_OF).collect()
    assert [(x.name, x.teachers, x.schools) for x in out] == [("Aug", 1, 1), ("Jan", 1, 0)]


def test_dashboard_counts_active_teachers_only(spark):
    s = H.schools(spark, [{"id": 1, "subscription_status": "TRIAL"}, {"id": 2, "subscription_status": "ACTIVE"},
                          {"id": 3}])
    t = H.teachers(spark, [{"id": 1}, {"id": 2, "profile_status": "PLACED"}])
    r = H.requests(spark, [{"teacher_id": 1, "school_id": 1}, {"teacher_id": 1, "school_id": 1, "status": "CLOSED"}])
    row = A.dashboard_counts(s, t, r).first()
    assert tuple(row) == (1, 1, 3, 1, 1)


def test_recent_requests_inner_joins_and_tiebreak(spark):
    s = H.schools(spark, [{"id": 1}])
    t = H.teachers(spark, [{"id": 1}])
    r = H.requests(spark, [{"id": 10, "teacher_id": 1, "school_id": 1}, {"id": 11, "teacher_id": 1, "school_id": 1},
                           {"id": 12, "teacher_id": 9, "school_id": 1}])
    assert [x.id for x in A.recent_requests(r, s, t).collect()] == [11, 10]


def _by_day(spark, tmp_path, rows):
    base = str(tmp_path / "wh")
    TB.write_snapshot(H.requests(spark, rows), base, "requests", 0, by_day=True)
    return TB.read_table(spark, base, "requests"), TB.partition_days(spark, base, "requests")


@pytest.mark.parametrize("orphans,steps", [(0, 1), (3, 3), (40, 6)])
def test_recent_requests_walk_reads_the_days_it_needs(spark, tmp_path, monkeypatch, orphans, steps):
    # 40 days of six requests each, those of the newest days by a school that is not there
    rows = [{"teacher_id": 1, "school_id": 9 if back < orphans else 1, "requested_at": AS_OF - dt.timedelta(days=back, hours=h)}
            for back in range(40) for h in (1, 2, 2, 3, 4, 5)]
    requests, days = _by_day(spark, tmp_path, rows)
    assert len(days) == 40 and days[0] == (AS_OF - dt.timedelta(hours=1)).date()
    s, t = H.schools(spark, [{"id": 1}]), H.teachers(spark, [{"id": 1}])
    want = A.recent_requests(requests, s, t).collect()
    walk, seen = A.recent_requests, []
    monkeypatch.setattr(A, "recent_requests", lambda r, *a: seen.append(r) or walk(r, *a))
    got = A.recent_requests_by_day(requests, s, t, days)
    assert got.collect() == want and len(seen) == steps
    assert "PartitionFilters" in seen[0]._jdf.queryExecution().toString()
    read = seen[0].select("requested_date").distinct().collect()
    assert [r.requested_date for r in read] == days[:1]


def test_recent_requests_walk_over_no_days(spark, tmp_path):
    s, t = H.schools(spark, [{"id": 1}]), H.teachers(spark, [{"id": 1}])
    requests = H.requests(spark, []).withColumn("requested_date", F.to_date("requested_at"))
    assert A.recent_requests_by_day(requests, s, t, []).count() == 0

"""Daily rollups: the answers of the log at any time, whatever was appended or archived since the last refresh."""

import datetime as dt

import pytest

from chalkline.operators import analytics as A
from chalkline.operators import rolled as RO
from chalkline.plans import jobs as J
from chalkline.sources import rollups as RU
from chalkline.sources import runs
from chalkline.sources import tables as TB
from tests import helpers as H

AS_OF = dt.datetime(2024, 1, 31, 15)


def seen(spark, *rows):
    return H.views(spark, [{"id": i, "teacher_id": t, "school_id": s, "viewed_at": AS_OF - dt.timedelta(days=d, hours=h)}
                           for i, (t, s, d, h) in enumerate(rows)])


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "wh")
    TB.write_snapshot(H.requests(spark, [{"teacher_id": 1, "school_id": 1, "requested_at": AS_OF - dt.timedelta(days=d)}
                                         for d in range(9)]), path, "requests", 1, by_day=True)
    TB.write_snapshot(H.teachers(spark, [{"id": t} for t in range(1, 6)]), path, "teachers", 1)
    TB.write_snapshot(H.schools(spark, [{"id": s, "region": f"R{s % 3}"} for s in range(1, 8)]), path, "schools", 1)
    TB.append_views(seen(spark, *[(1 + i % 5, 1 + i % 7 if i % 3 else 2, i % 9, i % 11) for i in range(150)]),
                    f"{path}/teacher_views")
    return path


def answers(spark, base, token="7d"):
    """(from rollups, from the log) of all five."""
    q, s, t = (TB.read_table(spark, base, n) for n in ("requests", "schools", "teachers"))
    log, r = J.live_views(spark, base), RU.RolledViews(spark, base, AS_OF, token)
    rolled = [RO.period_totals(r, q, AS_OF, token), RO.daily_activity(r, q, AS_OF, token), RO.top_schools(r, s),
              RO.top_teachers(r, t), RO.region_share(r, s)]
    plain = [A.period_totals(log, q, AS_OF, token), A.daily_activity(log, q, AS_OF, token), A.top_schools(log, s, AS_OF, token),
             A.top_teachers(log, t, AS_OF, token), A.region_share(log, s, AS_OF, token)]
    assert [x.dtypes for x in rolled] == [x.dtypes for x in plain]
    return [[tuple(x) for x in d.collect()] for d in rolled], [[tuple(x) for x in d.collect()] for d in plain]


def same(spark, base, token="7d"):
    got, want = answers(spark, base, token)
    assert got == want
    return got


@pytest.mark.parametrize("token", ["24h", "7d", "30d"])
def test_equal_to_the_log(spark, base, token):
    same(spark, base, token)                       # nothing stored yet
    RU.refresh(spark, base)
    assert same(spark, base, token)[0][0][0] > 0


def test_late_views_count_at_once_and_only_their_day_is_counted_again(spark, base):
    first = RU.refresh(spark, base)
    before = same(spark, base)
    TB.append_views(seen(spark, (1, 7, 3, 0), (1, 7, 3, 1)), f"{base}/teacher_views")
    assert same(spark, base)[0][0][0] == before[0][0][0] + 2
    late = (AS_OF - dt.timedelta(days=3)).date().isoformat()
    assert set(first["days"]) - set(RU.fresh_days(spark, base)) == {late}
    second = RU.refresh(spark, base)
    assert [d for d in second["days"] if second["days"][d] != first["days"][d]] == [late]
    assert same(spark, base)[0][0][0] == before[0][0][0] + 2
    third = RU.refresh(spark, base)
    assert third["days"] == second["days"] and third["n"] == second["n"] + 1


def test_archived_teachers_leave_the_counts_at_once(spark, base):
    RU.refresh(spark, base)
    J.archive_teachers(spark, base, spark.createDataFrame([(1, 2)], "seq long, id long"), AS_OF)
    assert 2 not in [r[0] for r in same(spark, base)[3]]
    done = RU.refresh(spark, base)
    assert done["dead"] and set(RU.fresh_days(spark, base)) == set(done["days"])
    assert 2 not in [r[0] for r in same(spark, base)[3]]


def test_a_day_whose_views_all_go_is_stored_as_empty(spark, base):
    TB.append_views(seen(spark, (3, 1, 40, 0)), f"{base}/teacher_views")
    RU.refresh(spark, base)
    J.archive_teachers(spark, base, spark.createDataFrame([(1, 3)], "seq long, id long"), AS_OF)
    done = RU.refresh(spark, base)
    assert done["days"][(AS_OF - dt.timedelta(days=40)).date().isoformat()]["run"] == ""
    same(spark, base, "90d")


def test_fresh_days_are_not_read_from_the_log(spark, base):
    RU.refresh(spark, base)
    r = RU.RolledViews(spark, base, AS_OF, "7d")
    days = {f.split("viewed_date=")[1][:10] for f in r.rest.inputFiles() if "viewed_date=" in f}
    only = {x.d.isoformat() for x in r.rest.selectExpr("cast(viewed_at as date) d").distinct().collect()}
    assert only <= {(AS_OF - dt.timedelta(days=7)).date().isoformat()} and days
    plan = r.rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "viewed_date" in plan.split("PartitionFilters: [")[1]


def test_empty_log_and_lost_refresh(spark, base, tmp_path, monkeypatch):
    empty = str(tmp_path / "empty")
    for name in ("requests", "teachers", "schools"):
        TB.write_snapshot(TB.read_table(spark, base, name), empty, name, 1)
    TB.append_views(H.views(spark, []), f"{empty}/teacher_views")
    RU.refresh(spark, empty)
    assert same(spark, empty)[0][0][:1] == (0,)

    def lost(*a):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(RU, "publish_file", lost)
        with pytest.raises(RuntimeError):
            RU.refresh(spark, base)
    assert RU.fresh_days(spark, base) == {}
    same(spark, base)
    RU.refresh(spark, base)
    n = TB.newest_numbered(spark, f"{base}/_rollups", "r")["n"]
    with pytest.raises(runs.ConcurrentRun):
        runs.publish_file(spark, f"{base}/_rollups", f"r={n}.json", "{}")


def test_sketches_merge_within_their_error(spark, tmp_path):
    path = str(tmp_path / "wh")
    many = spark.range(60000).selectExpr("id", "1L as teacher_id", "id % 20000 as school_id",
                                         "timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(cast(id % 6 as int), 1) as viewed_at")
    TB.append_views(many, f"{path}/teacher_views")
    RU.refresh(spark, path)
    got = RO.period_totals(RU.RolledViews(spark, path, AS_OF), H.requests(spark, []), AS_OF, approximate=True).first()
    assert got.views == 60000 and abs(got.active_schools - 20000) < 0.05 * 20000

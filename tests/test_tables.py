"""Snapshot storage and partition pruning."""

import datetime as dt

import pytest

from chalkline.operators import analytics as A
from chalkline.operators import changes as C
from chalkline.sources import tables as TB
from tests import helpers as H


def test_versioned_snapshots(spark, tmp_path):
    base = str(tmp_path / "wh")
    s = H.schools(spark, [{"id": 1, "subscription_status": "ACTIVE", "subscription_end_at": dt.datetime(2024, 1, 1)}])
    TB.write_snapshot(s, base, "schools", 1)
    cur = TB.read_table(spark, base, "schools")
    TB.write_snapshot(C.expire_subscriptions(cur, H.AS_OF), base, "schools", 2)
    assert TB.versions(spark, base, "schools") == [1, 2]
    assert TB.read_table(spark, base, "schools").first().subscription_status == "EXPIRED"
    assert TB.read_table(spark, base, "schools", 1).first().subscription_status == "ACTIVE"
    with pytest.raises(FileExistsError):
        TB.write_snapshot(cur, base, "schools", 2)


def test_day_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "views")
    TB.append_views(H.views(spark, [{"teacher_id": 1, "school_id": 1, "viewed_at": H.AS_OF - dt.timedelta(days=d)}
                                    for d in range(20)]), path)
    v = TB.read_views(spark, path)
    out = A.period_totals(v, H.requests(spark, []), H.AS_OF)
    assert out.first().views == 7
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(viewed_date" in plan


def test_failed_snapshot_attempt_is_replaced(spark, tmp_path):
    base = str(tmp_path / "wh")
    broken = tmp_path / "wh" / "schools" / "v=3"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"partial")        # no _SUCCESS: a failed attempt
    assert TB.versions(spark, base, "schools") == []
    TB.write_snapshot(H.schools(spark, [{"id": 1}]), base, "schools", 3)
    assert TB.versions(spark, base, "schools") == [3]
    assert TB.read_table(spark, base, "schools").count() == 1


def test_run_change_writes_next_version_and_rejects(spark, tmp_path):
    from chalkline.plans import jobs as J
    base = str(tmp_path / "wh")
    TB.write_snapshot(H.schools(spark, [{"id": 1, "subscription_status": "ACTIVE",
                                         "subscription_end_at": dt.datetime(2024, 1, 1)}, {"id": 2}]),
                      base, "schools", 1)
    r = J.hourly_expiry(spark, base, H.AS_OF)
    assert (r["from_version"], r["version"]) == (1, 2)
    o = spark.createDataFrame([(1, 2, "TRIAL", 24), (2, 9, "TRIAL", 24)],
                              "seq long, school_id long, status string, hours int")
    r = J.apply_overrides(spark, base, o, as_of=H.AS_OF)
    assert r["version"] == 3 and spark.read.parquet(r["rejects"]).count() == 1
    got = {x.id: x.subscription_status for x in TB.read_table(spark, base, "schools").collect()}
    assert got == {1: "EXPIRED", 2: "TRIAL"}


def test_tombstones_cascade_without_rewriting_the_log(spark, tmp_path):
    path, tomb = str(tmp_path / "views"), str(tmp_path / "tomb")
    TB.append_views(H.views(spark, [{"teacher_id": t, "school_id": 1, "viewed_at": H.AS_OF} for t in (1, 1, 2, 3)]),
                    path)
    t = H.teachers(spark, [{"id": 1}, {"id": 2}, {"id": 3}])
    d = spark.createDataFrame([(1, 1), (2, 99)], "seq long, id long")
    TB.append_tombstones(C.deleted_teacher_ids(t, d), tomb)
    live = TB.read_live_views(spark, path, tomb)
    assert sorted(x.teacher_id for x in live.collect()) == [2, 3]
    _, _, _, views_left, _ = C.archive_teachers(t, H.requests(spark, []), TB.read_views(spark, path), d, as_of=H.AS_OF)
    assert sorted(x.teacher_id for x in views_left.collect()) == [2, 3]     # same answer as the rewrite
    TB.compact_views(spark, path, tomb, str(tmp_path / "views2"))
    assert TB.read_views(spark, str(tmp_path / "views2")).count() == 2


def test_requests_snapshot_by_day_is_pruned(spark, tmp_path):
    base = str(tmp_path / "wh")
    r = H.requests(spark, [{"teacher_id": 1, "school_id": 1, "requested_at": H.AS_OF - dt.timedelta(days=d)}
                           for d in range(20)])
    TB.write_snapshot(r, base, "requests", 1, by_day=True)
    cur = TB.read_table(spark, base, "requests")
    assert "requested_date" in cur.columns
    out = A.period_totals(H.views(spark, []), cur, H.AS_OF)
    assert out.first().requests == 7
    assert "PartitionFilters: [isnotnull(requested_date" in out._jdf.queryExecution().executedPlan().toString()
    # change jobs keep working on the partitioned snapshot (the partition column is dropped on write)
    new, _ = C.apply_request_events(cur.drop("requested_date"), spark.createDataFrame(
        [], "seq long, kind string, request_id long, teacher_id long, school_id long, status string, "
            "message string, admin_notes string"), as_of=H.AS_OF)
    TB.write_snapshot(new, base, "requests", 2, by_day=True)
    assert TB.read_table(spark, base, "requests").count() == 20

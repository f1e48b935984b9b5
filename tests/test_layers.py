"""Layers of changed rows over a snapshot: merged on read, untouched days untouched, time travel, compaction."""

import datetime as dt
import os

import pytest

from chalkline.operators import changes as C
from chalkline.plans import jobs as J
from chalkline.sources import fixtures as fx
from chalkline.sources import layers as LY
from chalkline.sources import tables as TB
from chalkline.sources.runs import Run
from tests import helpers as H

SF = "/root/testdata/sf0.001"
EVENT = ("seq long, kind string, request_id long, teacher_id long, school_id long, status string, message string, "
         "admin_notes string, ts timestamp_ntz")


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "wh")
    TB.write_snapshot(H.requests(spark, [{"id": d, "teacher_id": d % 3, "school_id": 7, "requested_at": day(d)}
                                         for d in range(12)]), path, "requests", 1, by_day=True)
    TB.write_snapshot(H.teachers(spark, [{"id": t} for t in range(3)]), path, "teachers", 1)
    TB.write_snapshot(H.schools(spark, [{"id": 7}]), path, "schools", 1)
    TB.append_views(H.views(spark, []), f"{path}/teacher_views")
    return path


def day(n):
    return dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=n)


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "teacher_id", "requested_at", "status", "admin_notes").collect())


def files(base):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs
            if f.endswith(".parquet") and "/requests" in d}


def test_small_feed_writes_only_its_days(spark, base):
    before = files(base)
    ev = feed(spark, (1, "set_status", 4, None, None, "TEACHER_ACCEPTED", None, "ok", day(20)),
              (2, "create", 90, 1, 7, None, "", None, day(4)), (3, "close", 90, 1, 7, None, None, None, day(21)),
              (4, "create", 91, 99, 7, None, "", None, day(4)), (5, "set_status", 4, None, None, "NOPE", None, None, day(22)))
    want, _ = C.apply_request_events(TB.read_table(spark, base, "requests", 1).drop("requested_date"), ev,
                                     teachers=TB.read_table(spark, base, "teachers"),
                                     schools=TB.read_table(spark, base, "schools"))
    out = J.apply_request_events(spark, base, ev, run_id="f1")
    assert rows(TB.read_table(spark, base, "requests")) == rows(want)
    assert out["tables"]["requests"] == 1 and list(out["layers"]["requests"]) == ["2024-01-05"]
    now = files(base)
    assert {p: now[p] for p in before} == before
    assert all("requested_date=2024-01-05" in p for p in set(now) - set(before))
    assert sorted(r.seq for r in spark.read.parquet(out["outputs"]["rejects"]).collect()) == [4, 5]
    assert J.apply_request_events(spark, base, ev, run_id="f1") == out and files(base) == now


def test_newest_layer_wins_and_old_manifests_stay_readable(spark, base):
    one = J.apply_request_events(spark, base, feed(spark, (1, "set_status", 4, None, None, "CLOSED", None, "a", day(20))))
    two = J.apply_request_events(spark, base, feed(spark, (1, "set_status", 4, None, None, "PENDING", None, "b", day(21)),
                                                   (2, "set_status", 5, None, None, "CLOSED", None, "c", day(21))))

    def seen(manifest):
        t = TB.read_table(spark, base, "requests", manifest=manifest)
        return [(r.status, r.admin_notes) for r in t.filter("id in (4, 5)").orderBy("id").collect()]

    assert seen(0) == [("PENDING", None), ("PENDING", None)]
    assert seen(one["n"]) == [("CLOSED", "a"), ("PENDING", None)]
    assert seen(two["n"]) == seen(None) == [("PENDING", "b"), ("CLOSED", "c")]
    with pytest.raises(FileNotFoundError):
        TB.read_table(spark, base, "requests", manifest=99)


def test_compaction_rewrites_changed_days_only(spark, base):
    for n in range(3):
        J.apply_request_events(spark, base, feed(spark, (n, "set_status", 4, None, None, "CLOSED", None, str(n), day(20)),
                                                 (9, "create", 50 + n, 1, 7, None, "m", None, day(30 + n))))
    before, held = files(base), rows(TB.read_table(spark, base, "requests"))
    out = J.compact_requests(spark, base, min_deltas=3, run_id="c1")
    new = set(files(base)) - set(before)
    assert new and all("requested_date=2024-01-05" in p for p in new)
    assert out["layers"]["requests"]["2024-01-05"]["deltas"] == []
    assert rows(TB.read_table(spark, base, "requests")) == held
    J.compact_requests(spark, base)
    assert LY.due_for_compaction(TB.newest_manifest(spark, base)["layers"]["requests"]) == []
    assert rows(TB.read_table(spark, base, "requests")) == held
    J.apply_request_events(spark, base, feed(spark, (1, "set_status", 50, None, None, "CLOSED", None, "z", day(40))))
    got = TB.read_table(spark, base, "requests").filter("id = 50").collect()
    assert [(r.status, r.admin_notes) for r in got] == [("CLOSED", "z")]
    assert TB.partition_days(spark, base, "requests")[0] == dt.date(2024, 2, 2)


def test_removed_rows_stay_away_through_compaction(spark, base):
    J.archive_teachers(spark, base, spark.createDataFrame([(1, 0)], "seq long, id long"), H.AS_OF)
    left = [n for n in range(12) if n % 3 != 0]
    assert [r[0] for r in rows(TB.read_table(spark, base, "requests"))] == left
    J.compact_requests(spark, base)
    assert [r[0] for r in rows(TB.read_table(spark, base, "requests"))] == left
    entry = TB.newest_manifest(spark, base)["layers"]["requests"]["2024-01-01"]
    assert entry == {"bottom": "", "deltas": []}                                  # its only request has gone
    out = J.apply_request_events(spark, base, feed(spark, (1, "create", 0, 1, 7, None, "again", None, day(0))))
    assert "2024-01-01" in out["layers"]["requests"]
    assert TB.read_table(spark, base, "requests").filter("id = 0").count() == 1


def test_whole_rewrite_drops_the_layers(spark, base):
    J.apply_request_events(spark, base, feed(spark, (1, "set_status", 4, None, None, "CLOSED", None, "a", day(20))))
    held = rows(TB.read_table(spark, base, "requests"))
    run = Run(spark, base)
    run.write("requests", run.read("requests"), by_day=True)
    out = run.publish()
    assert "requests" not in out["layers"] and rows(TB.read_table(spark, base, "requests")) == held


def test_empty_feed_and_rows_without_a_day(spark, base):
    out = J.apply_request_events(spark, base, feed(spark))
    assert out["layers"]["requests"] == {} and TB.read_table(spark, base, "requests").count() == 12
    run = Run(spark, base)
    odd = spark.createDataFrame([(70, 1, 7, None, "PENDING", None, None)],
                                "id long, teacher_id long, school_id long, requested_at timestamp_ntz, status string, "
                                "school_message string, admin_notes string")
    assert run.change("requests", odd) == [LY.NO_DAY]
    run.publish()
    assert TB.read_table(spark, base, "requests").count() == 13
    J.compact_requests(spark, base)
    assert TB.read_table(spark, base, "requests").filter("requested_date is null").count() == 1


def test_day_bound_prunes_rows_and_plain_days_are_not_joined(spark, base):
    J.apply_request_events(spark, base, feed(spark, (1, "set_status", 4, None, None, "CLOSED", None, "a", day(20))))
    cur = TB.read_table(spark, base, "requests")
    late = cur.filter("requested_date >= DATE'2024-01-08'")
    assert late.count() == 5
    plan = late._jdf.queryExecution().explainString(late.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [part.split("\n\n")[0] for part in plan.split(") Scan parquet")[1:]]
    whole = [s for s in scans if "status" in s]                    # the scans of rows; one more reads the deltas' ids
    assert len(whole) == 3 and all("requested_date" in s.split("PartitionFilters: ")[1].split("\n")[0] for s in whole)
    assert plan.count("BroadcastHashJoin LeftAnti") == 1 and plan.count("SortMergeJoin") == 0


def test_fixture_feed_through_layers_equals_the_rewrite(spark, tmp_path):
    from chalkline.plans.catalog import AS_OF, Fixture
    path, f = str(tmp_path / "wh"), Fixture(spark, SF)
    for name in ("schools", "teachers", "requests"):
        TB.write_snapshot(getattr(f, name), path, name, 1, by_day=name == "requests")
    J.apply_request_events(spark, path, fx.request_events(spark, SF), AS_OF)
    want, _ = C.apply_request_events(f.requests, fx.request_events(spark, SF), AS_OF, f.teachers, f.schools)
    assert rows(TB.read_table(spark, path, "requests")) == rows(want)

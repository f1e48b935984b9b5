"""Runs over several tables: all or nothing, once per run id, one winner of two."""

import pytest

from chalkline.plans import jobs as J
from chalkline.plans.catalog import AS_OF, Fixture
from chalkline.sources import fixtures as fx
from chalkline.sources import runs
from chalkline.sources import tables as TB

SF = "/root/testdata/sf0.001"


@pytest.fixture
def base(spark, tmp_path):
    path, f = str(tmp_path / "wh"), Fixture(spark, SF)
    for name in ("schools", "teachers", "requests", "access_codes"):
        TB.write_snapshot(getattr(f, name), path, name, 1)
    TB.append_views(f.views, f"{path}/teacher_views")
    return path


def state(spark, base):
    return {t: TB.current_version(spark, base, t) for t in ("schools", "teachers", "requests", "access_codes")}


def cancels(spark, base):
    ids = [r.school_id for r in TB.read_table(spark, base, "access_codes").filter("school_id is not null").limit(3).collect()]
    return spark.createDataFrame([(i, s) for i, s in enumerate(ids)] + [(90, -5)], "seq long, id long"), ids


def test_crash_between_two_tables_changes_nothing(spark, base, monkeypatch):
    feed, ids = cancels(spark, base)
    write = runs.Run.write

    def crash(self, table, df, by_day=False):
        if table == "access_codes":
            raise RuntimeError("lost driver")
        return write(self, table, df, by_day)

    before = TB.read_table(spark, base, "schools").collect()
    with monkeypatch.context() as m:
        m.setattr(runs.Run, "write", crash)
        with pytest.raises(RuntimeError):
            J.cancel_subscriptions(spark, base, feed, AS_OF, run_id="day-1")
    assert TB.versions(spark, base, "schools") == [1, 2]                # version 2 is written, but nobody's
    assert state(spark, base)["schools"] == 1
    assert sorted(TB.read_table(spark, base, "schools").collect()) == sorted(before)

    done = J.cancel_subscriptions(spark, base, feed, AS_OF, run_id="day-1")
    assert done["tables"]["schools"] == 3 and done["tables"]["access_codes"] == 2
    got = TB.read_table(spark, base, "schools").filter(f"id in ({','.join(map(str, ids))})").collect()
    assert {r.subscription_status for r in got} == {"NO_SUBSCRIPTION"}
    codes = TB.read_table(spark, base, "access_codes").filter(f"school_id in ({','.join(map(str, ids))})").collect()
    assert {r.status for r in codes} == {"EXPIRED"}
    assert [r.seq for r in spark.read.parquet(done["outputs"]["rejects"]).collect()] == [90]


def test_published_run_id_changes_nothing(spark, base):
    feed, _ = cancels(spark, base)
    first = J.cancel_subscriptions(spark, base, feed, AS_OF, run_id="day-1")
    again = J.cancel_subscriptions(spark, base, feed, AS_OF, run_id="day-1")
    assert again == first and TB.versions(spark, base, "schools") == [1, 2]
    assert J.cancel_subscriptions(spark, base, feed, AS_OF, run_id="day-2")["tables"]["schools"] == 3
    one = J.hourly_expiry(spark, base, AS_OF, run_id="hour-1")
    assert J.hourly_expiry(spark, base, AS_OF, run_id="hour-1")["version"] == one["version"]


def test_one_of_two_runs_wins(spark, base):
    one, two = runs.Run(spark, base, "a"), runs.Run(spark, base, "b")
    one.write("schools", one.read("schools"))
    two.write("schools", two.read("schools"))
    one.publish()
    with pytest.raises(runs.ConcurrentRun):
        two.publish()
    assert state(spark, base)["schools"] == one.tables["schools"]
    assert runs.published_run(spark, base, "b") is None
    third = runs.Run(spark, base, "b")
    assert third.version("schools") == one.tables["schools"]            # reads what won


def test_redeem_and_register_publish_both_tables(spark, base):
    out = J.redeem_access_codes(spark, base, fx.redeem_attempts(spark, SF), AS_OF, run_id="r1")
    assert out["tables"]["schools"] == 2 and out["tables"]["access_codes"] == 2
    assert spark.read.parquet(out["outputs"]["outcomes"]).count() == fx.redeem_attempts(spark, SF).count()
    code = TB.read_table(spark, base, "access_codes").filter("status = 'UNUSED'").first().code
    signups = spark.createDataFrame(
        [(1, "New", "C", "new@x.org", "X", "R", code), (2, "Late", "C", "late@x.org", "X", "R", code)],
        "seq long, name string, contact_name string, email string, country string, region string, access_code string")
    n = TB.read_table(spark, base, "schools").count()
    out = J.register_schools(spark, base, signups, AS_OF, run_id="s1")
    new = TB.read_table(spark, base, "schools").filter("email = 'new@x.org'").first()
    assert new.subscription_status == "TRIAL" and TB.read_table(spark, base, "schools").count() == n + 1
    used = TB.read_table(spark, base, "access_codes").filter(f"code = '{code}'").first()
    assert (used.status, used.school_id) == ("ACTIVE", new.id)
    assert spark.read.parquet(out["outputs"]["rejects"]).count() == 1


def test_archive_cascades_through_every_table(spark, base):
    views = J.live_views(spark, base)
    tid = views.groupBy("teacher_id").count().orderBy("count", ascending=False).first().teacher_id
    known = TB.read_table(spark, base, "teachers").filter(f"id = {tid}").count()
    assert known == 1
    feed = spark.createDataFrame([(1, tid), (2, -1)], "seq long, id long")
    n = views.count()
    J.archive_teachers(spark, base, feed, AS_OF, run_id="gone-1")
    J.archive_teachers(spark, base, feed, AS_OF, run_id="gone-1")
    assert J.live_views(spark, base).filter(f"teacher_id = {tid}").count() == 0 < n
    assert TB.read_table(spark, base, "requests").filter(f"teacher_id = {tid}").count() == 0
    assert TB.read_table(spark, base, "teachers").filter(f"id = {tid}").count() == 0
    archive = runs.read_appended(spark, base, J.ARCHIVE)
    assert [r.original_teacher_id for r in archive.collect()] == [tid]
    other = J.live_views(spark, base).first().teacher_id
    J.archive_teachers(spark, base, spark.createDataFrame([(1, other)], "seq long, id long"), AS_OF, run_id="gone-2")
    archive = runs.read_appended(spark, base, J.ARCHIVE).collect()
    assert len({r.archive_id for r in archive}) == len(archive) == 2


def test_request_events_and_codes_as_jobs(spark, base):
    out = J.apply_request_events(spark, base, fx.request_events(spark, SF), AS_OF, run_id="e1")
    new = TB.read_table(spark, base, "requests")
    assert out["tables"]["requests"] == 1 and "requested_date" in new.columns      # a layer, no new snapshot
    ops = spark.createDataFrame([(1, "create", "FRESH", None), (2, "create", "FRESH", None)],
                                "seq long, op string, code string, id string")
    J.maintain_access_codes(spark, base, ops, AS_OF, run_id="c1")
    assert TB.read_table(spark, base, "access_codes").filter("code = 'FRESH'").count() == 1

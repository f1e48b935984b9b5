"""Streams (S1-S4): batch answers, late data, orphan quarantine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chalkline.sources import schemas as sch
from chalkline.streaming import store
from chalkline.streaming import views as SV
from tests import helpers as H


def _view_dir(spark, tmp_path, rows, name="views"):
    d = str(tmp_path / name)
    spark.createDataFrame(rows, sch.TEACHER_VIEWS).coalesce(1).write.parquet(d)
    return d


def _stream(spark, d):
    return spark.readStream.schema(sch.TEACHER_VIEWS).parquet(d)


def test_utc_helpers_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 30),)], "t timestamp_ntz")
        assert df.select(SV.utc_day(SV.utc_instant(F.col("t")))).first()[0] == dt.date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ingest_quarantines_orphans(spark, tmp_path):
    t = H.teachers(spark, [{"id": 1}])
    s = H.schools(spark, [{"id": 1}])
    d = _view_dir(spark, tmp_path, [(1, 1, 1, H.AS_OF), (2, 9, 1, H.AS_OF), (3, 1, 9, H.AS_OF)])
    out = SV.view_ingest(spark, _stream(spark, d), t, s, out_dir=str(tmp_path / "out"))
    assert [x.id for x in SV.read_ingested(spark, out).collect()] == [1]
    got = {x.id: x.reason for x in SV.read_quarantine(spark, out).collect()}
    assert got == {2: "Teacher not found", 3: "School not found"}


def test_daily_counts_append_drops_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 10)
    first = [(i, 1, 1, base + dt.timedelta(hours=6 * i)) for i in range(12)]     # 10th..12th
    d = str(tmp_path / "in")
    spark.createDataFrame(first, sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/a")
    stream = spark.readStream.schema(sch.TEACHER_VIEWS).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    out = str(tmp_path / "daily")
    SV.live_daily_counts(spark, stream, out_dir=out, mode="append")
    # a row two days behind the watermark arrives later: it is dropped, open days are not emitted yet
    spark.createDataFrame([(99, 1, 1, base - dt.timedelta(days=2))], sch.TEACHER_VIEWS).coalesce(1) \
        .write.parquet(d + "/b")
    SV.live_daily_counts(spark, stream, out_dir=out, mode="append")
    got = {x.day: x.views for x in SV.read_daily_counts(spark, out).collect()}
    assert dt.date(2024, 1, 8) not in got
    assert got.get(dt.date(2024, 1, 10)) == 4


def test_top_and_active_schools(spark, tmp_path):
    s = H.schools(spark, [{"id": i, "country": "X"} for i in range(1, 4)])
    rows = [(i, 1, sid, H.AS_OF) for i, sid in enumerate([1, 1, 2, 2, 2, 3, 77, 77, 77, 77])]
    d = _view_dir(spark, tmp_path, rows)
    top = SV.read_top_schools(spark, SV.live_top_schools(spark, _stream(spark, d), s, out_dir=str(tmp_path / "t")))
    assert [(x.school_id, x.views) for x in top.orderBy(F.desc("views"), "school_id").collect()] == [
        (2, 3), (1, 2), (3, 1)]
    act = SV.read_active_schools(spark, SV.live_active_schools(spark, _stream(spark, d), out_dir=str(tmp_path / "a")))
    assert [(x.day, x.active_schools) for x in act.collect()] == [(dt.date(2024, 1, 31), 4)]


def test_writer_with_processing_time_trigger(spark, tmp_path):
    d = _view_dir(spark, tmp_path, [(1, 1, 1, H.AS_OF), (2, 1, 2, H.AS_OF)])
    out = str(tmp_path / "pt")
    w = SV.daily_counts_writer(_stream(spark, d), out)
    q = w.trigger(processingTime="1 second").queryName("pt_daily").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(x.day, x.views) for x in SV.read_daily_counts(spark, out).collect()] == [(dt.date(2024, 1, 31), 2)]


def test_ingest_sees_dimension_refresh(spark, tmp_path):
    state = {"teachers": H.teachers(spark, [{"id": 1}])}
    s = H.schools(spark, [{"id": 1}])
    d = str(tmp_path / "in")
    spark.createDataFrame([(1, 2, 1, H.AS_OF)], sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/a")
    stream = spark.readStream.schema(sch.TEACHER_VIEWS).parquet(d + "/*")
    out = str(tmp_path / "out")
    SV.view_ingest(spark, stream, lambda: state["teachers"], s, out_dir=out)
    assert SV.read_quarantine(spark, out).count() == 1              # teacher 2 unknown at first
    state["teachers"] = H.teachers(spark, [{"id": 1}, {"id": 2}])   # snapshot refreshed
    spark.createDataFrame([(2, 2, 1, H.AS_OF)], sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/b")
    SV.view_ingest(spark, stream, lambda: state["teachers"], s, out_dir=out)
    assert [x.id for x in SV.read_ingested(spark, out).collect()] == [2]


def test_missing_view_time(spark):
    t, s = H.teachers(spark, [{"id": 1}]), H.schools(spark, [{"id": 1}])
    b = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, H.AS_OF)],
                              "id long, teacher_id long, school_id long, viewed_at timestamp_ntz")
    ok, bad = SV.validate_views(b, t, s)
    assert [x.id for x in ok.collect()] == [2] and [x.reason for x in bad.collect()] == ["View time missing"]
    ok, bad = SV.validate_views(b, t, s, as_of=H.AS_OF)
    assert ok.count() == 2 and bad.count() == 0


def _ids(df):
    return sorted(x.id for x in df.collect())


def _batch(spark, *ids, teacher=9):
    return spark.createDataFrame([(i, teacher, 1, H.AS_OF) for i in ids], sch.TEACHER_VIEWS)


def test_batch_that_died_before_its_commit_is_not_seen_and_runs_again(spark, tmp_path, monkeypatch):
    t, s, out = H.teachers(spark, [{"id": 1}]), H.schools(spark, [{"id": 1}]), str(tmp_path / "out")
    SV.write_view_batch(_batch(spark, 1, teacher=1), 0, t, s, out)
    batch = _batch(spark, 2, teacher=1).union(_batch(spark, 3))
    with monkeypatch.context() as m:
        m.setattr(store, "publish_file", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            SV.write_view_batch(batch, 1, t, s, out)
    assert _ids(SV.read_ingested(spark, out)) == [1] and _ids(SV.read_quarantine(spark, out)) == []
    both = H.teachers(spark, [{"id": 1}, {"id": 9}])
    SV.write_view_batch(batch, 1, both, s, out)         # the retry meets a newer snapshot
    assert _ids(SV.read_ingested(spark, out)) == [1, 2, 3] and _ids(SV.read_quarantine(spark, out)) == []
    SV.write_view_batch(batch, 1, t, s, out)            # a replay of a published batch
    assert _ids(SV.read_ingested(spark, out)) == [1, 2, 3] and _ids(SV.read_quarantine(spark, out)) == []


def test_held_views_leave_quarantine_once(spark, tmp_path):
    s, out = H.schools(spark, [{"id": 1}]), str(tmp_path / "out")
    none, nine = H.teachers(spark, [{"id": 1}]), H.teachers(spark, [{"id": 9}])
    SV.write_view_batch(_batch(spark, 1, 2), 0, none, s, out)
    SV.write_view_batch(_batch(spark, 3).union(_batch(spark, 4, teacher=7)), 1, none, s, out)
    assert SV.rejudge_quarantine(spark, out, nine, s)
    assert _ids(SV.read_ingested(spark, out)) == [1, 2, 3] and _ids(SV.read_quarantine(spark, out)) == [4]
    assert len(store.newest(spark, out)["tables"]["quarantine"]) == 1
    SV.rejudge_quarantine(spark, out, nine, s)
    assert _ids(SV.read_ingested(spark, out)) == [1, 2, 3] and _ids(SV.read_quarantine(spark, out)) == [4]
    days = SV.read_ingested(spark, out).select("viewed_date").distinct().collect()
    assert [r.viewed_date for r in days] == [H.AS_OF.date()]


def test_rejudging_beside_the_stream_and_beside_another(spark, tmp_path, monkeypatch):
    s, out = H.schools(spark, [{"id": 1}]), str(tmp_path / "out")
    none, nine = H.teachers(spark, [{"id": 1}]), H.teachers(spark, [{"id": 9}])
    SV.write_view_batch(_batch(spark, 1), 0, none, s, out)
    write = SV._write_judged

    def meanwhile(then):
        def judge_and(*args):
            got = write(*args)
            monkeypatch.setattr(SV, "_write_judged", write)
            then()
            return got
        monkeypatch.setattr(SV, "_write_judged", judge_and)

    meanwhile(lambda: SV.write_view_batch(_batch(spark, 2), 1, none, s, out))
    assert SV.rejudge_quarantine(spark, out, nine, s)
    assert _ids(SV.read_ingested(spark, out)) == [1] and _ids(SV.read_quarantine(spark, out)) == [2]
    meanwhile(lambda: SV.rejudge_quarantine(spark, out, nine, s))
    assert not SV.rejudge_quarantine(spark, out, nine, s)
    assert _ids(SV.read_ingested(spark, out)) == [1, 2] and _ids(SV.read_quarantine(spark, out)) == []


def test_reader_during_a_batch_sees_the_last_whole_result(spark, tmp_path):
    out, seen = str(tmp_path / "r"), []
    day = lambda n: spark.createDataFrame([(H.AS_OF.date(), n)], SV.DAILY_SCHEMA)
    assert SV.read_daily_counts(spark, out).count() == 0
    store.publish_result(day(1), out, 0)
    half = f"{store.new_folder(out)}"
    day(99).write.parquet(half)                          # a writer at work, or one that died
    seen.append(SV.read_daily_counts(spark, out).first().views)
    plan = SV.read_daily_counts(spark, out)              # planned before the next batch, read after it
    store.publish_result(day(2), out, 1)
    seen += [plan.first().views, SV.read_daily_counts(spark, out).first().views]
    store.publish_result(day(3), out, 1)                 # batch 1 once more
    seen.append(SV.read_daily_counts(spark, out).first().views)
    assert seen == [1, 1, 2, 2]


def test_old_versions_of_a_result_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEPT_VERSIONS", 2)
    out = str(tmp_path / "r")
    for n in range(6):
        store.publish_result(spark.createDataFrame([(H.AS_OF.date(), n)], SV.DAILY_SCHEMA), out, n)
    assert len(list((tmp_path / "r" / "data").iterdir())) == 3
    assert SV.read_daily_counts(spark, out).first().views == 5


def test_top_schools_takes_the_snapshot_of_each_batch(spark, tmp_path):
    names = {"now": "Old"}
    dim = lambda: H.schools(spark, [{"id": 1, "name": names["now"]}])
    d, out = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(1, 1, 1, H.AS_OF)], sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/a")
    stream = spark.readStream.schema(sch.TEACHER_VIEWS).parquet(d + "/*")
    SV.live_top_schools(spark, stream, dim, out_dir=out)
    names["now"] = "New"
    spark.createDataFrame([(2, 1, 1, H.AS_OF)], sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/b")
    SV.live_top_schools(spark, stream, dim, out_dir=out)
    assert [(r.name, r.views) for r in SV.read_top_schools(spark, out).collect()] == [("New", 2)]


def test_active_schools_are_counted_once_over_batches(spark, tmp_path):
    d, out = str(tmp_path / "in"), str(tmp_path / "a")
    day = dt.timedelta(days=1)
    spark.createDataFrame([(i, 1, i % 3, H.AS_OF) for i in range(9)], sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/a")
    stream = spark.readStream.schema(sch.TEACHER_VIEWS).parquet(d + "/*")
    SV.live_active_schools(spark, stream, out_dir=out)
    more = [(20, 1, 0, H.AS_OF), (21, 1, 7, H.AS_OF), (22, 1, 0, H.AS_OF + day)]
    spark.createDataFrame(more, sch.TEACHER_VIEWS).coalesce(1).write.parquet(d + "/b")
    sink = SV.live_active_schools(spark, stream, out_dir=out)
    got = {r.day: r.active_schools for r in SV.read_active_schools(spark, sink).collect()}
    assert got == {H.AS_OF.date(): 4, (H.AS_OF + day).date(): 1}

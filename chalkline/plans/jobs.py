"""Scheduled change jobs over stored tables: read the published versions, write the next ones, publish them together.

A scheduler (cron, Airflow, a streaming trigger) calls a job with its feed and a run id of its own (the hour, the feed
file's name). Every job is one ``sources.runs.Run``: all its tables, rejects and outcomes become visible with one
manifest. A job that fails can be run again; a run id that is published already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators import changes as C
from chalkline.operators import redeem as RD
from chalkline.sources import rollups
from chalkline.sources import schemas as sch
from chalkline.sources import tables as TB
from chalkline.sources.runs import Run, read_appended

TOMBSTONES, ARCHIVE = rollups.TOMBSTONES, "archived_teachers"


def _finish(run: Run, rejects: DataFrame | None = None, **outputs: DataFrame | None) -> dict:
    for name, df in {"rejects": rejects, **outputs}.items():
        if df is not None:
            run.output(name, df)
    return run.publish()


def run_change(spark: SparkSession, base: str, table: str, job: Callable[[DataFrame], DataFrame | tuple],
               run_id: str | None = None, by_day: bool = False) -> dict:
    """Apply ``job(snapshot) -> new | (new, rejects)`` to ``table``; returns the written version and paths."""
    run = Run(spark, base, run_id)
    before = run.version(table)
    if run.done:
        return _described(base, table, None, run.done)
    out = job(run.read(table))
    new, rejects = (out[0], out[1]) if isinstance(out, tuple) else (out, None)
    run.write(table, new, by_day)
    return _described(base, table, before, _finish(run, rejects))


def _described(base: str, table: str, before: int | None, manifest: dict) -> dict:
    version = manifest["tables"][table]
    return {"table": table, "from_version": before, "version": version,
            "path": f"{base.rstrip('/')}/{table}/v={version}", **manifest["outputs"]}


def hourly_expiry(spark: SparkSession, base: str, as_of, run_id: str | None = None) -> dict:
    """M1 as a scheduled job (the reference runs it hourly)."""
    return run_change(spark, base, "schools", lambda s: C.expire_subscriptions(s, as_of), run_id)


def apply_overrides(spark: SparkSession, base: str, overrides: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M8 as a scheduled job over an override feed."""
    return run_change(spark, base, "schools", lambda s: C.override_subscription(s, overrides, as_of), run_id)


def apply_request_events(spark: SparkSession, base: str, events: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M10: creates, status changes and closes of requests, stored as a layer of changed rows (``sources.layers``)."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    changed, rejects = C.changed_requests(_stored(run, "requests"), events, as_of,
                                          teachers=run.read("teachers"), schools=run.read("schools"))
    run.change("requests", changed)
    return _finish(run, rejects)


def compact_requests(spark: SparkSession, base: str, min_deltas: int = 1, run_id: str | None = None) -> dict:
    """Write the days of ``requests`` with at least ``min_deltas`` deltas again, and no other day."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    run.compact("requests", min_deltas)
    return run.publish()


def _stored(run: Run, table: str) -> DataFrame:
    """A table's own columns, without the partition column."""
    return run.read(table).select(*[f.name for f in sch.TABLES[table].fields])


def maintain_access_codes(spark: SparkSession, base: str, feed: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M11: new codes and codes that expire."""
    return run_change(spark, base, "access_codes", lambda c: C.maintain_access_codes(c, feed, as_of), run_id)


def redeem_access_codes(spark: SparkSession, base: str, attempts: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M5: schools and access codes change together; every attempt's outcome is kept."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    outcomes, schools, codes = RD.redeem_access_codes(run.read("schools"), run.read("access_codes"), attempts, as_of)
    run.write("schools", schools)
    run.write("access_codes", codes)
    return _finish(run, outcomes=outcomes)


def register_schools(spark: SparkSession, base: str, signups: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M6: new schools and the codes that they use."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    schools = run.read("schools")
    inserted, rejects, codes = C.register_schools(schools, signups, run.read("access_codes"), as_of)
    run.write("schools", schools.unionByName(inserted, allowMissingColumns=True))
    run.write("access_codes", codes)
    return _finish(run, rejects)


def cancel_subscriptions(spark: SparkSession, base: str, cancels: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M9: cancelled schools and all their codes."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    schools, codes, rejects = C.cancel_subscriptions(run.read("schools"), run.read("access_codes"), cancels, as_of)
    run.write("schools", schools)
    run.write("access_codes", codes)
    return _finish(run, rejects)


def archive_teachers(spark: SparkSession, base: str, delete_ids: DataFrame, as_of=None, run_id: str | None = None) -> dict:
    """M2: teachers go, the archive grows; requests get a layer of ``_gone`` rows and the view log tombstones, neither is
    written again."""
    run = Run(spark, base, run_id)
    if run.done:
        return run.done
    teachers, requests = run.read("teachers"), _stored(run, "requests")
    views = TB.read_views(spark, f"{run.base}/teacher_views")
    archive, left, _, _, rejects = C.archive_teachers(
        teachers, requests, views, delete_ids, read_appended(spark, run.base, ARCHIVE), as_of)
    run.append(ARCHIVE, archive)
    run.append(TOMBSTONES, C.deleted_teacher_ids(teachers, delete_ids).withColumnRenamed("id", "teacher_id"))
    run.write("teachers", left)
    gone = C.deleted_teacher_ids(teachers, delete_ids).withColumnRenamed("id", "teacher_id")
    run.change("requests", requests.join(gone, "teacher_id", "left_semi").withColumn("_gone", F.lit(True)))
    return _finish(run, rejects)


def refresh_rollups(spark: SparkSession, base: str) -> dict:
    """Count the days of the view log that changed since the last refresh (``sources.rollups``)."""
    manifest = rollups.refresh(spark, base)
    return {"n": manifest["n"], "days": len(manifest["days"])}


def live_views(spark: SparkSession, base: str) -> DataFrame:
    """The view log as published: without the views of archived teachers."""
    return TB.read_live_views(spark, f"{base.rstrip('/')}/teacher_views", read_appended(spark, base, TOMBSTONES))

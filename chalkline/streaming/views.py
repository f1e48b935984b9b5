"""The view log as a stream (S1-S4).

* S1 ``view_ingest``: each micro-batch meets the teacher and school
  snapshots once, in ``foreachBatch``; views of known ones go to the fact,
  the others to quarantine. ``rejudge_quarantine`` takes the quarantined
  views to newer snapshots, and those now known move to the fact.
* S2 ``live_daily_counts``: views per day with a 1-day watermark; state is
  one row per open day.
* S3 ``live_top_schools``: all-time views per school (state: one row per
  school); names are joined and the top-n taken on the aggregated state in
  ``foreachBatch``, so the stream never joins raw events to a dimension.
* S4 ``live_active_schools``: distinct schools per day, exactly: the stream
  emits each (day, school) once and the pairs are counted when read.

Results are published by commits (``streaming.store``): a reader sees the
state before a batch or after it, and a batch that runs twice counts once.

Watermarks need ``TIMESTAMP``; the fixtures are ``TIMESTAMP_NTZ``. The
event time is converted with ``utc_instant`` (wall clock read as UTC,
independent of the session time zone) and day labels come back through
``utc_day``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.session import scratch_path
from chalkline.sources import schemas as sch
from chalkline.streaming import store

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

MICROS_PER_DAY = 86_400_000_000


def utc_instant(ntz: Column) -> Column:
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant, reading the wall clock as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ntz))


def utc_day(instant: Column) -> Column:
    """Calendar day (UTC) of a TIMESTAMP instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / MICROS_PER_DAY).cast("int"))


def view_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming view log from the events table (one parquet file in a flat folder)."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = r.parquet(sf_dir).filter(F.col("event_type") == "view")
    return ev.select(F.col("event_id").alias("id"),
                     F.get_json_object("props", "$.k").cast("long").alias("teacher_id"),
                     F.col("user_id").alias("school_id"),
                     F.col("ts").alias("viewed_at"))


def request_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming request log (purchase events) from the same events table."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = r.parquet(sf_dir).filter(F.col("event_type") == "purchase")
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("school_id"),
                     F.col("ts").alias("requested_at"))


def validate_views(batch: DataFrame, teachers: DataFrame, schools: DataFrame, as_of=None):
    """S1 rule on one batch: default viewed_at, keep views of known teachers and
    schools, quarantine the rest. Returns (accepted, quarantined).

    A missing viewed_at takes ``as_of`` when one is given. Otherwise the row is
    quarantined, not stamped with the processing time: a replayed batch must
    produce exactly the same rows and day partitions.
    """
    tagged = judged(batch, teachers, schools, as_of)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def judged(batch: DataFrame, teachers: DataFrame, schools: DataFrame, as_of=None) -> DataFrame:
    """``batch`` with S1's default time and its ``reason`` column."""
    from chalkline.functions.time import ts_lit
    if as_of is not None:
        batch = batch.withColumn("viewed_at", F.coalesce(F.col("viewed_at"), ts_lit(as_of)))
    return tag_views(batch, teachers, schools)


def tag_views(batch: DataFrame, teachers: DataFrame, schools: DataFrame) -> DataFrame:
    """``batch`` with ``reason`` (null: accepted), by one left join per dimension."""
    t = teachers.select(F.col("id").alias("teacher_id"), F.lit(True).alias("_teacher")).distinct()
    s = schools.select(F.col("id").alias("school_id"), F.lit(True).alias("_school")).distinct()
    reason = (F.when(F.col("viewed_at").isNull(), "View time missing")
              .when(F.col("_teacher").isNull(), "Teacher not found").when(F.col("_school").isNull(), "School not found"))
    return (batch.join(t, "teacher_id", "left").join(s, "school_id", "left").withColumn("reason", reason)
            .select(*batch.columns, "reason"))


def run_to_end(writer, name: str) -> None:
    """Process everything available now, then stop (batch-style replay and tests); a deadline is the caller's."""
    q = writer.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


#: What readers of S1's two results see.
FACT_SCHEMA = T.StructType([*sch.TEACHER_VIEWS.fields, T.StructField("viewed_date", T.DateType())])
QUARANTINE_SCHEMA = T.StructType([*sch.TEACHER_VIEWS.fields, T.StructField("reason", T.StringType())])


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """The published fact of S1, with its partition column ``viewed_date``."""
    return store.read(spark, out_dir, "teacher_views", FACT_SCHEMA)


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """The views that S1 holds back at present, with the reason."""
    return store.read(spark, out_dir, "quarantine", QUARANTINE_SCHEMA)


def _write_judged(views: DataFrame, teachers: DataFrame, schools: DataFrame, out_dir: str, as_of) -> tuple[list, list]:
    """Judge and write ``views`` in one pass; returns the folders of accepted and of quarantined rows (each 0 or 1)."""
    folder = store.new_folder(out_dir)
    (judged(views.select(*sch.TEACHER_VIEWS.names), teachers, schools, as_of)
     .withColumn("accepted", F.col("reason").isNull()).withColumn("viewed_date", F.to_date("viewed_at"))
     .write.partitionBy("accepted", "viewed_date").parquet(folder))
    spark = views.sparkSession
    return store.existing(spark, f"{folder}/accepted=true"), store.existing(spark, f"{folder}/accepted=false")


def write_view_batch(batch: DataFrame, batch_id: int, teachers: DataFrame, schools: DataFrame, out_dir: str,
                     as_of=None) -> None:
    """Judge one batch and publish both of its parts in one commit. A batch that is published already changes nothing."""
    if batch_id <= store.newest(batch.sparkSession, out_dir)["batch"]:
        return
    good, bad = _write_judged(batch, teachers, schools, out_dir, as_of)
    store.commit(batch.sparkSession, out_dir, lambda now: {
        "batch": batch_id, "adds": {"teacher_views": good},
        "tables": {"quarantine": [*now["tables"].get("quarantine", []), *bad]}})


def rejudge_quarantine(spark: SparkSession, out_dir: str, teachers: DataFrame, schools: DataFrame, as_of=None) -> bool:
    """Judge all quarantined views by newer snapshots; returns whether anything was published.

    Views that pass join the fact and leave quarantine in the same commit, so each is in one of them and never in
    both; the others are written together, which also compacts quarantine. The stream may go on meanwhile: batches
    it adds stay as they are. Of two such jobs at once, the one that commits second finds its folders gone and
    publishes nothing. Run it after a teacher or school snapshot is published.
    """
    held = store.newest(spark, out_dir)["tables"].get("quarantine", [])
    if not held:
        return False
    views = store.read_folders(spark, out_dir, held, QUARANTINE_SCHEMA)
    good, bad = _write_judged(views, teachers, schools, out_dir, as_of)

    def move(now: dict) -> dict | None:
        present = now["tables"].get("quarantine", [])
        if not set(held) <= set(present):
            return None
        return {"adds": {"teacher_views": good},
                "tables": {"quarantine": [*(f for f in present if f not in held), *bad]}}

    return store.commit(spark, out_dir, move) is not None


# ---- writer builders: configured sinks; the caller picks the trigger and starts ----

def view_ingest_writer(views: DataFrame, teachers, schools, out_dir: str, as_of=None):
    """S1 sink below ``out_dir`` (``read_ingested``, ``read_quarantine``). ``teachers``/``schools`` are
    DataFrames or zero-argument callables returning the current snapshot; callables are asked at every batch, so
    teachers and schools added while the stream runs become valid."""

    def write_batch(batch: DataFrame, batch_id: int):
        write_view_batch(batch, batch_id, teachers() if callable(teachers) else teachers,
                         schools() if callable(schools) else schools, out_dir, as_of)

    return views.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{out_dir}/_checkpoint")


def daily_counts_frame(views: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """S2 aggregate: views (and requests, when given) per UTC day.

    The two streams are tagged and unioned, then counted in one windowed
    aggregate with a 1-day watermark on the event time, so state is one row
    per open day whatever the event rate.
    """
    t = views.select(utc_instant(F.col("viewed_at")).alias("_t"), F.lit(1).alias("_v"), F.lit(0).alias("_r"))
    if requests is not None:
        t = t.unionByName(requests.select(utc_instant(F.col("requested_at")).alias("_t"),
                                          F.lit(0).alias("_v"), F.lit(1).alias("_r")))
    agg = (t.withWatermark("_t", "1 day").groupBy(F.window("_t", "1 day").alias("w"))
           .agg(F.sum("_v").cast("long").alias("views"), F.sum("_r").cast("long").alias("requests")))
    cols = [utc_day(F.col("w.start")).alias("day"), "views"] + (["requests"] if requests is not None else [])
    return agg.select(*cols)


#: What readers of the live results see.
DAILY_SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("views", T.LongType())])
DAILY_REQUESTS_SCHEMA = T.StructType([*DAILY_SCHEMA.fields, T.StructField("requests", T.LongType())])
TOP_SCHEMA = T.StructType([T.StructField("school_id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("location", T.StringType()), T.StructField("views", T.LongType())])
PAIR_SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("school_id", T.LongType())])


def daily_counts_writer(views: DataFrame, out_dir: str, mode: str = "complete", requests: DataFrame | None = None):
    """S2 sink (``read_daily_counts``). ``append`` publishes each day once the watermark has passed it; ``complete``
    publishes the small full result, one version a batch."""
    agg = daily_counts_frame(views, requests)
    put = store.append_result if mode == "append" else store.publish_result
    return (agg.writeStream.outputMode(mode).foreachBatch(lambda df, batch_id: put(df, out_dir, batch_id))
            .option("checkpointLocation", f"{out_dir}/_checkpoint"))


def read_daily_counts(spark: SparkSession, out_dir: str, requests: bool = False) -> DataFrame:
    return store.read(spark, out_dir, "result", DAILY_REQUESTS_SCHEMA if requests else DAILY_SCHEMA)


def top_schools_writer(views: DataFrame, schools, out_dir: str, n: int = 5):
    """S3 sink (``read_top_schools``): per-school counts as state; names and top-n on the state per batch. ``schools``
    is a DataFrame or a zero-argument callable that is asked for the current snapshot at every batch."""
    counts = views.groupBy("school_id").agg(F.count(F.lit(1)).alias("views"))

    def write_top(state: DataFrame, batch_id: int):
        dim = ((schools() if callable(schools) else schools)
               .select(F.col("id").alias("school_id"), "name", F.col("country").alias("location")))
        store.publish_result(state.join(dim, "school_id").orderBy(F.desc("views"), F.asc("school_id")).limit(n)
                             .select(*TOP_SCHEMA.names), out_dir, batch_id)

    return (counts.writeStream.outputMode("complete").foreachBatch(write_top)
            .option("checkpointLocation", f"{out_dir}/_checkpoint"))


def read_top_schools(spark: SparkSession, out_dir: str) -> DataFrame:
    return store.read(spark, out_dir, "result", TOP_SCHEMA)


def active_schools_writer(views: DataFrame, out_dir: str):
    """S4 sink: the first view of each (UTC day, school), once. State is one row per pair of an open day; the watermark
    drops closed days. ``read_active_schools`` counts the published pairs."""
    first = (views.withColumn("_t", utc_instant(F.col("viewed_at"))).withWatermark("_t", "1 day")
             .select(F.window("_t", "1 day").alias("w"), "school_id").dropDuplicates(["w", "school_id"]))

    def write_batch(df: DataFrame, batch_id: int):
        store.append_result(df.select(utc_day(F.col("w.start")).alias("day"), "school_id"), out_dir, batch_id)

    return (first.writeStream.outputMode("append").foreachBatch(write_batch)
            .option("checkpointLocation", f"{out_dir}/_checkpoint"))


def read_active_schools(spark: SparkSession, out_dir: str) -> DataFrame:
    """Distinct schools per day so far, exactly: every pair is stored once."""
    pairs = store.read(spark, out_dir, "result", PAIR_SCHEMA)
    return pairs.groupBy("day").agg(F.count("school_id").alias("active_schools"))


# ---- run-to-end forms (replay, registered queries, tests); each returns the folder of its results ------------

def view_ingest(spark, views: DataFrame, teachers, schools, out_dir: str | None = None, as_of=None) -> str:
    """S1: run the ingest stream to the end of its input."""
    out_dir = out_dir or scratch_path(spark, "view-ingest")
    run_to_end(view_ingest_writer(views, teachers, schools, out_dir, as_of), "view_ingest")
    return out_dir


def live_daily_counts(spark, views: DataFrame, out_dir: str | None = None, mode: str = "complete",
                      requests: DataFrame | None = None) -> str:
    out_dir = out_dir or scratch_path(spark, "daily-counts")
    run_to_end(daily_counts_writer(views, out_dir, mode, requests), "live_daily_counts")
    return out_dir


def live_top_schools(spark, views: DataFrame, schools, n: int = 5, out_dir: str | None = None) -> str:
    out_dir = out_dir or scratch_path(spark, "top-schools")
    run_to_end(top_schools_writer(views, schools, out_dir, n), "live_top_schools")
    return out_dir


def live_active_schools(spark, views: DataFrame, out_dir: str | None = None) -> str:
    out_dir = out_dir or scratch_path(spark, "active-schools")
    run_to_end(active_schools_writer(views, out_dir), "live_active_schools")
    return out_dir

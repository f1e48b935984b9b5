"""Dashboard queries over the view/request log (Q1-Q8).

Scale notes
-----------
* The facts (views, requests) are the only unbounded inputs. Every query
  filters them first (the ``> as_of - interval`` predicate reaches the parquet
  scan) and aggregates them *before* touching a dimension, so joins see at
  most one row per school / teacher / day. A hot key (one school with a third
  of all views) is collapsed by the map-side partial aggregate.
* Dimension joins are left to the planner: AQE measures the aggregated side at
  runtime and broadcasts only below ``autoBroadcastJoinThreshold``; above it a
  sort-merge join is used. Explicit ``broadcast()`` is used only for inputs
  with a proven bound (the date spine: at most 91 rows).
* Top-k is ``orderBy(...).limit(n)`` which plans as TakeOrderedAndProject:
  a per-partition heap, no global sort.
* No cross joins: one-row summaries over several tables are computed from a
  tagged ``unionByName`` and a single global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.time import ts_lit, window_start
from chalkline.sources.tables import prune_by_day

# Sentinel range: no lower bound (all-time leaderboards).
ALL_TIME = object()

# Region chart colours, assigned by rank (rank modulo 5).
REGION_COLORS = ["#3b82f6", "#10b981", "#f59e0b", "#64748b", "#8b5cf6"]


def recent_views(views: DataFrame, as_of, range_token="7d") -> DataFrame:
    """Views strictly after ``as_of - range``; no upper bound (future rows count).

    On the day-partitioned fact the implied ``viewed_date`` bound is added so
    whole partitions are skipped, not only row groups.
    """
    lo = window_start(as_of, range_token)
    return prune_by_day(views, lo).filter(F.col("viewed_at") > lo)


def recent_requests_in(requests: DataFrame, as_of, range_token="7d") -> DataFrame:
    """Requests strictly after ``as_of - range`` (day partitions pruned when present)."""
    lo = window_start(as_of, range_token)
    return prune_by_day(requests, lo, "requested_date").filter(F.col("requested_at") > lo)


def period_totals(views: DataFrame, requests: DataFrame, as_of, range_token="7d",
                  approximate: bool = False) -> DataFrame:
    """Q1: one row with views, requests, active_schools and conversion (%).

    ``approximate=True`` counts active schools with HyperLogLog++
    (``approx_count_distinct``): no shuffle by school id, fixed memory.
    """
    v = recent_views(views, as_of, range_token).select(
        F.lit(True).alias("is_view"), F.col("school_id"))
    r = recent_requests_in(requests, as_of, range_token).select(
        F.lit(False).alias("is_view"), F.lit(None).cast("long").alias("school_id"))
    t = v.unionByName(r).agg(
        F.count_if(F.col("is_view")).alias("views"),
        F.count_if(~F.col("is_view")).alias("requests"),
        (F.approx_count_distinct("school_id") if approximate
         else F.count_distinct("school_id")).alias("active_schools"),
    )
    return t.withColumn("conversion", conversion(F.col("requests"), F.col("views")))


def conversion(requests, views):
    """Q1b: requests per 100 views, one decimal; 0.0 when there are no views."""
    return (F.when(views > 0, F.round(requests.cast("double") / views * 100, 1))
            .otherwise(F.lit(0.0)))


def date_spine(spark_or_df, as_of, range_token="7d") -> DataFrame:
    """One row per calendar day from date(as_of - range) to date(as_of), inclusive."""
    spark = getattr(spark_or_df, "sparkSession", spark_or_df)
    lo = window_start(as_of, range_token)
    return spark.range(1).select(F.explode(F.sequence(
        F.to_date(lo), F.to_date(ts_lit(as_of)), F.expr("INTERVAL 1 DAY"))).alias("day"))


def daily_activity(views: DataFrame, requests: DataFrame, as_of, range_token="7d") -> DataFrame:
    """Q2: views and requests per day over a gap-filled spine, oldest day first.

    Both facts are tagged, unioned and counted per day in one aggregate. Days
    after ``as_of`` cannot meet the spine, so they are filtered before the
    shuffle; the counted side is then at most 91 rows and safe to broadcast.
    """
    last_day = F.to_date(ts_lit(as_of))
    v = recent_views(views, as_of, range_token).select(
        F.to_date("viewed_at").alias("day"), F.lit(1).alias("v"), F.lit(0).alias("r"))
    r = recent_requests_in(requests, as_of, range_token).select(
        F.to_date("requested_at").alias("day"), F.lit(0).alias("v"), F.lit(1).alias("r"))
    per_day = (v.unionByName(r).filter(F.col("day") <= last_day)
               .groupBy("day").agg(F.sum("v").alias("views"), F.sum("r").alias("requests")))
    return on_spine(per_day, as_of, range_token)


def on_spine(per_day: DataFrame, as_of, range_token="7d") -> DataFrame:
    """(day, views, requests), one row a day and none after ``as_of``, over the gap-filled spine."""
    spine = date_spine(per_day, as_of, range_token)
    return (spine.join(F.broadcast(per_day), "day", "left")
            .select(
                "day",
                F.date_format("day", "E").alias("name"),
                F.date_format("day", "yyyy-MM-dd").alias("full_date"),
                F.coalesce("views", F.lit(0)).cast("long").alias("views"),
                F.coalesce("requests", F.lit(0)).cast("long").alias("requests"))
            .orderBy("day"))


def _counts_by(views: DataFrame, key: str, as_of, range_token, name: str) -> DataFrame:
    """Views per key in the window; ``range_token=ALL_TIME`` counts the whole log
    (the batch form of the live leaderboard)."""
    v = views if range_token is ALL_TIME else recent_views(views, as_of, range_token)
    return v.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_schools(views: DataFrame, schools: DataFrame, as_of, range_token="7d", n: int = 5) -> DataFrame:
    """Q3: most-viewing schools. Ties broken by school id ascending.

    Aggregate by school id first (partial + final), then join the school
    dimension (inner: views of unknown schools drop out), then take top-n.
    """
    return first_schools(_counts_by(views, "school_id", as_of, range_token, "views"), schools, n)


def first_schools(counts: DataFrame, schools: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` schools with most views of (school_id, views)."""
    dim = schools.select(F.col("id").alias("school_id"), "name", F.col("country").alias("location"))
    return (counts.join(dim, "school_id")
            .orderBy(F.desc("views"), F.asc("school_id")).limit(n)
            .select("school_id", "name", "location", "views"))


def top_teachers(views: DataFrame, teachers: DataFrame, as_of, range_token="7d", n: int = 5) -> DataFrame:
    """Q4: most-viewed teachers (code, name, hits). Ties by teacher id ascending."""
    return first_teachers(_counts_by(views, "teacher_id", as_of, range_token, "hits"), teachers, n)


def first_teachers(counts: DataFrame, teachers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` teachers with most hits of (teacher_id, hits)."""
    dim = teachers.select(F.col("id").alias("teacher_id"), F.col("teacher_code").alias("code"),
                          F.col("full_name").alias("name"))
    return (counts.join(dim, "teacher_id")
            .orderBy(F.desc("hits"), F.asc("teacher_id")).limit(n)
            .select("teacher_id", "code", "name", "hits"))


def region_share(views: DataFrame, schools: DataFrame, as_of, range_token="7d", n: int = 5) -> DataFrame:
    """Q5: views per region label, top-n with a colour by rank.

    The label falls back region -> country -> 'Other' (an empty string is a
    value). Two aggregates: views per school, then per label after the join.
    """
    return first_regions(_counts_by(views, "school_id", as_of, range_token, "value"), schools, n)


def first_regions(counts: DataFrame, schools: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` region labels with most views of (school_id, value), with rank and colour."""
    dim = schools.select(F.col("id").alias("school_id"),
                         F.coalesce("region", "country", F.lit("Other")).alias("name"))
    top = (counts.join(dim, "school_id").groupBy("name").agg(F.sum("value").alias("value"))
           .orderBy(F.desc("value"), F.asc("name")).limit(n))
    # ranking window runs over the n rows left after the limit
    rank = F.row_number().over(Window.orderBy(F.desc("value"), F.asc("name"))) - 1
    colors = F.array(*[F.lit(c) for c in REGION_COLORS])
    return (top.withColumn("rank", rank.cast("int"))
            .withColumn("color", F.element_at(colors, (F.pmod(F.col("rank"), F.lit(len(REGION_COLORS))) + 1)))
            .select("rank", "name", F.col("value").cast("long").alias("value"), "color"))


def dashboard_counts(schools: DataFrame, teachers: DataFrame, requests: DataFrame) -> DataFrame:
    """Q6: active_trials, paid_subscriptions, total_schools, total_teachers
    (profile ACTIVE only) and pending_requests in one scan per table."""
    s = schools.select(F.lit("s").alias("t"), F.col("subscription_status").alias("v"))
    t = teachers.select(F.lit("t").alias("t"), F.col("profile_status").alias("v"))
    r = requests.select(F.lit("r").alias("t"), F.col("status").alias("v"))
    tag, v = F.col("t"), F.col("v")
    return s.unionByName(t).unionByName(r).agg(
        F.count_if((tag == "s") & (v == "TRIAL")).alias("active_trials"),
        F.count_if((tag == "s") & (v == "ACTIVE")).alias("paid_subscriptions"),
        F.count_if(tag == "s").alias("total_schools"),
        F.count_if((tag == "t") & (v == "ACTIVE")).alias("total_teachers"),
        F.count_if((tag == "r") & (v == "PENDING")).alias("pending_requests"),
    )


def monthly_growth(teachers: DataFrame, schools: DataFrame, as_of) -> DataFrame:
    """Q7: new teachers and schools per month over the last six months.

    Up to seven buckets (the first is partial); empty months are omitted.
    """
    lo = ts_lit(as_of) - F.expr("INTERVAL 6 MONTHS")
    u = (teachers.select("created_at", F.lit("teacher").alias("type"))
         .unionByName(schools.select("created_at", F.lit("school").alias("type")))
         .filter(F.col("created_at") > lo))
    month = F.to_date(F.date_trunc("month", "created_at"))
    return (u.groupBy(month.alias("month"))
            .agg(F.count_if(F.col("type") == "teacher").alias("teachers"),
                 F.count_if(F.col("type") == "school").alias("schools"))
            .select("month", F.date_format("month", "MMM").alias("name"), "teachers", "schools")
            .orderBy("month"))


def recent_requests(requests: DataFrame, schools: DataFrame, teachers: DataFrame, n: int = 5) -> DataFrame:
    """Q8: latest n requests with school name and teacher code.

    Inner joins (requests of unknown schools/teachers drop out); newest first,
    ties by request id descending.
    """
    s = schools.select(F.col("id").alias("school_id"), F.col("name").alias("school_name"))
    t = teachers.select(F.col("id").alias("teacher_id"), "teacher_code")
    return (requests.select(F.col("id"), "school_id", "teacher_id", "requested_at", "status")
            .join(s, "school_id").join(t, "teacher_id")
            .orderBy(F.desc("requested_at"), F.desc("id")).limit(n)
            .select("id", "school_name", "teacher_code", "requested_at", "status"))


def recent_requests_by_day(requests: DataFrame, schools: DataFrame, teachers: DataFrame, days: list, n: int = 5) -> DataFrame:
    """Q8 on a day-partitioned snapshot (``tables.partition_days``), as a walk from the newest day back.

    ``days`` are the partitions' dates, newest first. Each step joins the requests
    of the next one, two, four, ... days and keeps its newest ``n``; the walk ends when it has ``n`` rows, so it
    mostly reads a day or two. No day is read twice, and where all new requests are orphans it goes back as far as it
    must. At most ``n`` rows a step come to the driver.
    """
    found, at, width = [], 0, 1
    while True:
        some = days[at:at + width]
        part = F.col("requested_date").between(F.lit(some[-1]), F.lit(some[0])) if some else F.lit(False)
        step = recent_requests(requests.filter(part), schools, teachers, n)
        found += step.collect()
        at, width = at + width, 2 * width
        if len(found) >= n or at >= len(days):
            return requests.sparkSession.createDataFrame(found[:n], step.schema)

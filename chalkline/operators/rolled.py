"""Q1-Q5 from stored daily counts (``sources.rollups``): the answers of ``operators.analytics``, read from a few rows a
day and key. Requests are counted from their own table, whose day partitions are pruned and of which one column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.time import ts_lit
from chalkline.operators import analytics as A
from chalkline.sources.rollups import RolledViews


def period_totals(views: RolledViews, requests: DataFrame, as_of, range_token="7d", approximate: bool = False) -> DataFrame:
    """Q1. Active schools are counted exactly, or with ``approximate=True`` from the merged day sketches: then no row per
    school is read (relative standard error 1.6 %)."""
    asked = A.recent_requests_in(requests, as_of, range_token).agg(F.count(F.lit(1)).alias("requests"))
    if approximate:
        seen = views.days().agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
                                F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("active_schools"))
        seen = seen.withColumn("active_schools", F.coalesce("active_schools", F.lit(0)))
    else:
        seen = (views.by("school_id").groupBy("school_id").agg(F.sum("views").alias("views"))
                .agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.count("school_id").alias("active_schools")))
    # two frames of one row each become one row through a tagged union and an aggregate, not a cross join
    parts = seen.unionByName(asked, allowMissingColumns=True)
    return (parts.agg(*[F.max(c).alias(c) for c in ("views", "requests", "active_schools")])
            .withColumn("conversion", A.conversion(F.col("requests"), F.col("views"))))


def daily_activity(views: RolledViews, requests: DataFrame, as_of, range_token="7d") -> DataFrame:
    """Q2 over the day counts."""
    last = F.to_date(ts_lit(as_of))
    v = views.days().select("day", F.col("views").alias("v"), F.lit(0).cast("long").alias("r"))
    r = (A.recent_requests_in(requests, as_of, range_token)
         .select(F.to_date("requested_at").alias("day"), F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("r")))
    per_day = (v.unionByName(r).filter(F.col("day") <= last)
               .groupBy("day").agg(F.sum("v").alias("views"), F.sum("r").alias("requests")))
    return A.on_spine(per_day, as_of, range_token)


def _sums(views: RolledViews, key: str, name: str) -> DataFrame:
    return views.by(key).groupBy(key).agg(F.sum("views").alias(name))


def top_schools(views: RolledViews, schools: DataFrame, n: int = 5) -> DataFrame:
    """Q3."""
    return A.first_schools(_sums(views, "school_id", "views"), schools, n)


def top_teachers(views: RolledViews, teachers: DataFrame, n: int = 5) -> DataFrame:
    """Q4."""
    return A.first_teachers(_sums(views, "teacher_id", "hits"), teachers, n)


def region_share(views: RolledViews, schools: DataFrame, n: int = 5) -> DataFrame:
    """Q5."""
    return A.first_regions(_sums(views, "school_id", "value"), schools, n)

"""Bindings from the generated test tables to the marketplace domain tables.

The same formulas are written in DuckDB SQL in ``chalkline.plans.oracle``;
keep the two in step. Every binding is a lazy projection/join over the given
parquet tables, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.time import days, hours, ts_lit
from chalkline.session import scratch_path
from chalkline.sources import schemas as sch

# Fixed value: the replay time of the events binding (events run 1-30 Jan 2024).
FIXTURE_AS_OF = "2024-01-31 00:00:00"
# Fixed value: replay time of the line-item view log (ship dates end 2001-11-04).
LINEITEM_AS_OF = "2001-11-05 00:00:00"

# Fixed value: a teacher or school created before is in the former snapshot (fifty days before FIXTURE_AS_OF).
FORMER_SNAPSHOT = "2023-12-12 00:00:00"

# Error events are split into change feeds by event_id % FEED_SLOTS.
FEED_SLOTS = 10
SLOT = {
    "teacher_patches": 0, "school_patches": 1, "signups": 2, "checkout_events": 3,
    "subscription_overrides": 4, "request_creates": 5, "delete_ids": 6, "cancel_ids": 7,
    "code_maintenance": 8, "plan_wants": 9,
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """``values[index]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def padded(key: Column, width: int) -> Column:
    """The key with zeros before it, ``width`` digits at least; a longer key is not cut."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _mod(c: str, n: int) -> Column:
    return F.pmod(F.col(c), F.lit(n))


def schools(spark, sf_dir, as_of=FIXTURE_AS_OF) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    seg = F.col("c_mktsegment")
    status = (F.when(seg.isin("AUTOMOBILE", "MACHINERY"), "ACTIVE")
              .when(seg == "BUILDING", "TRIAL")
              .when(seg == "FURNITURE", "EXPIRED")
              .otherwise("NO_SUBSCRIPTION"))
    key = F.col("c_custkey")
    end = F.when(status != "NO_SUBSCRIPTION",
                 ts_lit(as_of) + days((_mod("c_custkey", 61) - 30).cast("int")))
    created = ts_lit(as_of) - days(_mod("c_custkey", 300).cast("int"))
    return j.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Contact "), key.cast("string")).alias("contact_name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.lit(None).cast("string").alias("website"),
        F.when(_mod("c_custkey", 11) != 0, F.col("n_name")).alias("country"),
        F.when(_mod("c_custkey", 5) != 0, F.col("r_name")).alias("region"),
        F.lit(None).cast("string").alias("about"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("address"),
        status.alias("subscription_status"),
        F.when(status == "ACTIVE", pick(sch.SUBSCRIPTION_PLANS, _mod("c_custkey", 3))).alias("subscription_plan"),
        (end - days(30)).alias("subscription_started_at"),
        end.alias("subscription_end_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (_mod("c_custkey", 2) == 0).alias("verified"),
    )


def teachers(spark, sf_dir, as_of=FIXTURE_AS_OF) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    key = F.col("p_partkey")
    created = ts_lit(as_of) - days(_mod("p_partkey", 400).cast("int"))
    null_s = F.lit(None).cast("string")
    return p.select(
        key.alias("id"),
        F.concat(F.lit("T-"), padded(key, 5)).alias("teacher_code"),
        F.col("p_name").alias("full_name"),
        F.concat(F.lit("t"), key.cast("string"), F.lit("@example.org")).alias("email"),
        null_s.alias("phone"), null_s.alias("cv_link"),
        F.col("p_brand").alias("current_job_title"),
        F.when(_mod("p_partkey", 7) != 0, F.col("p_name")).alias("subjects"),
        F.col("p_type").alias("highest_qualification"),
        null_s.alias("current_country"), null_s.alias("current_region"),
        null_s.alias("visa_status"), null_s.alias("notice_period"),
        F.lit(False).alias("will_move_sem1"), F.lit(False).alias("will_move_sem2"),
        F.col("p_size").cast("int").alias("years_experience"),
        null_s.alias("preferred_regions"), null_s.alias("bio"), null_s.alias("current_school_name"),
        pick(sch.PROFILE_STATUSES, _mod("p_size", 3)).alias("profile_status"),
        (_mod("p_size", 4) != 0).alias("is_visible_in_school_portal"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def events(spark, sf_dir, event_type: str | None = None) -> DataFrame:
    e = read(spark, sf_dir, "events")
    if event_type is not None:
        e = e.filter(F.col("event_type") == event_type)
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.get_json_object("props", "$.k").cast("long").alias("k"))


def teacher_views(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "view").select(
        F.col("event_id").alias("id"), F.col("k").alias("teacher_id"),
        F.col("user_id").alias("school_id"), F.col("ts").alias("viewed_at"))


def requests(spark, sf_dir) -> DataFrame:
    eid = F.col("event_id")
    return events(spark, sf_dir, "purchase").select(
        eid.alias("id"), F.col("k").alias("teacher_id"), F.col("user_id").alias("school_id"),
        F.col("ts").alias("requested_at"),
        pick(sch.REQUEST_STATUSES, _mod("event_id", 5)).alias("status"),
        F.when(_mod("event_id", 3) != 0, F.concat(F.lit("Message "), eid.cast("string"))).alias("school_message"),
        F.when(_mod("event_id", 4) == 0, F.lit(None).cast("string"))
         .when(_mod("event_id", 4) == 1, F.lit("")).otherwise(F.lit("note")).alias("admin_notes"),
    )


def access_codes(spark, sf_dir) -> DataFrame:
    status = pick(sch.ACCESS_CODE_STATUSES, _mod("event_id", 3))
    code = F.concat(F.lit("C"), F.col("event_id").cast("string"))
    used = status != "UNUSED"
    return events(spark, sf_dir, "signup").select(
        code.alias("id"), code.alias("code"),
        F.when(used & (_mod("user_id", 2) == 1), F.col("user_id")).alias("school_id"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(used, F.col("ts")).alias("first_used_at"),
        F.when(used, F.col("ts") + hours(24)).alias("expires_at"),
    )


def redeem_attempts(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "click").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("school_id"),
        F.concat(F.lit("C"), F.expr("event_id div 3").cast("string")).alias("code"), "ts")


def feed_events(spark, sf_dir, feed: str) -> DataFrame:
    """Error events assigned to one change feed, with ``seq`` = event_id."""
    e = events(spark, sf_dir, "error")
    return (e.filter(_mod("event_id", FEED_SLOTS) == SLOT[feed])
             .withColumn("seq", F.col("event_id"))
             .withColumn("n", F.floor(F.col("event_id") / FEED_SLOTS).cast("long")))


def lineitem_views(spark, sf_dir) -> DataFrame:
    """Large view log: one view per line item (FIXTURES §2.3)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("teacher_id"), F.col("o_custkey").alias("school_id"),
        F.col("l_shipdate").alias("viewed_at"))


def lineitem_requests(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("school_id"),
                    F.col("o_orderdate").alias("requested_at"))


def plan_wants(spark, sf_dir) -> DataFrame:
    """Plan purchase attempts: (seq, school_id, requested_plan); k % 5 picks
    BASIC, PRO, ULTIMATE, an unknown plan, or no plan."""
    f = feed_events(spark, sf_dir, "plan_wants")
    plan = (F.when(_mod("k", 5) < 3, pick(sch.SUBSCRIPTION_PLANS, _mod("k", 5)))
            .when(_mod("k", 5) == 3, F.lit("GOLD")))
    return f.select("seq", F.col("user_id").alias("school_id"), plan.alias("requested_plan"))


# ---- change feeds (all derived from events / part) ----------------------------------

def _smap(*kv) -> Column:
    """map<string,string> from alternating key/value columns (values may be null)."""
    if not kv:
        return F.create_map().cast("map<string,string>")
    cols = []
    for i, x in enumerate(kv):
        cols.append(F.lit(x) if i % 2 == 0 else x.cast("string"))
    return F.create_map(*cols)


def _unknown_if(n_mod10_9: Column, key: Column) -> Column:
    return F.when(n_mod10_9, key + 1000000).otherwise(key)


def teacher_patches(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "teacher_patches")
    n, k = F.col("n"), F.col("k")
    null = F.lit(None).cast("string")
    changes = (F.when(F.pmod(n, F.lit(4)) == 0, _smap("subjects", F.concat(F.lit("Subject "), F.pmod(k, F.lit(13)).cast("string"))))
               .when(F.pmod(n, F.lit(4)) == 1, _smap("bio", null))
               .when(F.pmod(n, F.lit(4)) == 2, _smap("profile_status", F.lit("PLACED"),
                                                     "is_visible_in_school_portal", F.lit("false")))
               .otherwise(_smap("years_experience", F.pmod(n, F.lit(40)).cast("string"),
                                "current_region", F.concat(F.lit("Region "), F.pmod(n, F.lit(7)).cast("string")),
                                "subjects", null)))
    return f.select("seq", _unknown_if(F.pmod(n, F.lit(10)) == 9, k).alias("id"), changes.alias("changes"), "ts")


def school_patches(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "school_patches")
    n, k, u = F.col("n"), F.col("k"), F.col("user_id")
    m = F.pmod(n, F.lit(5))
    changes = (F.when(m == 0, _smap("description", F.concat(F.lit("About "), n.cast("string")),
                                    "city", F.concat(F.lit("City "), F.pmod(k, F.lit(9)).cast("string"))))
               .when(m == 1, _smap("email", F.concat(F.lit("shared"), F.expr("n div 25").cast("string"),
                                                     F.lit("@example.org"))))
               .when(m == 2, _smap())
               .when(m == 3, _smap("email", F.concat(F.lit("customer#"), padded(k, 9),
                                                     F.lit("@example.org")),
                                   "name", F.concat(F.lit("Renamed "), n.cast("string"))))
               .otherwise(_smap("phone", F.lit(None).cast("string"),
                                "region", F.concat(F.lit("Region "), F.pmod(k, F.lit(3)).cast("string")))))
    return f.select("seq", _unknown_if(F.pmod(n, F.lit(10)) == 9, u).alias("id"), changes.alias("changes"), "ts")


def signups(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "signups")
    n, k = F.col("n"), F.col("k")
    email = (F.when(F.pmod(n, F.lit(7)) == 0, F.lit("not-an-email"))
             .when(F.pmod(n, F.lit(7)) == 1, F.concat(F.lit("Customer#"), padded(k, 9),
                                                      F.lit("@Example.org")))
             .otherwise(F.concat(F.lit("New"), F.expr("n div 4").cast("string"), F.lit("@Example.org"))))
    return f.select(
        "seq",
        F.when(F.pmod(n, F.lit(6)) == 0, F.lit("")).otherwise(F.concat(F.lit("New School "), n.cast("string"))).alias("name"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.concat(F.lit("Contact "), n.cast("string"))).alias("contact_name"),
        email.alias("email"),
        F.concat(F.lit("Country "), F.pmod(k, F.lit(4)).cast("string")).alias("country"),
        F.lit(None).cast("string").alias("region"),
        F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit("C"), (n * 7).cast("string"))).alias("access_code"),
        "ts")


def checkout_events(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "checkout_events")
    n, k, u = F.col("n"), F.col("k"), F.col("user_id")
    return f.select(
        "seq",
        F.concat(F.lit("cs_"), F.expr("n div 8").cast("string")).alias("session_id"),
        u.alias("school_id"),
        F.when(F.pmod(k, F.lit(9)) == 0, F.lit("wrong@example.org"))
         .otherwise(F.concat(F.lit("customer#"), padded(u, 9), F.lit("@example.org"))).alias("email"),
        F.when(F.pmod(k, F.lit(4)) < 3, pick(sch.SUBSCRIPTION_PLANS, F.pmod(k, F.lit(4)))).otherwise(F.lit("GOLD")).alias("plan"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit("unpaid")).otherwise(F.lit("paid")).alias("payment_status"),
        "ts")


def subscription_overrides(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "subscription_overrides")
    n, k = F.col("n"), F.col("k")
    m = F.pmod(k, F.lit(5))
    status = (F.when(m < 3, pick(["TRIAL", "ACTIVE", "EXPIRED"], m)).when(m == 3, F.lit("BOGUS")))
    return f.select("seq", _unknown_if(F.pmod(n, F.lit(10)) == 9, F.col("user_id")).alias("school_id"),
                    status.alias("status"), (F.pmod(k, F.lit(50)) - 5).cast("int").alias("hours"), "ts")


def request_events(spark, sf_dir) -> DataFrame:
    """create (error events), set_status and close (derived from purchases)."""
    null_s, null_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    f = feed_events(spark, sf_dir, "request_creates")
    n, eid = F.col("n"), F.col("event_id")
    creates = f.select(
        (eid * 4).alias("seq"), F.lit("create").alias("kind"),
        (eid - F.when(F.pmod(n, F.lit(4)) == 1, 10).otherwise(0)).alias("request_id"),  # some ids twice, some orphans
        F.when(F.pmod(n, F.lit(17)) == 0, -F.col("k")).otherwise(F.col("k")).alias("teacher_id"),
        F.when(F.pmod(n, F.lit(19)) == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("school_id"),
        null_s.alias("status"),
        F.when(F.pmod(n, F.lit(3)) == 1, F.lit("")).when(F.pmod(n, F.lit(3)) == 2,
                                                         F.concat(F.lit("Hello "), n.cast("string"))).alias("message"),
        null_s.alias("admin_notes"), "ts")
    p = events(spark, sf_dir, "purchase")
    q = F.expr("event_id div 7")
    sets = p.filter(F.pmod(eid, F.lit(7)) == 0).select(
        (eid * 4 + 1).alias("seq"), F.lit("set_status").alias("kind"), eid.alias("request_id"),
        null_l.alias("teacher_id"), null_l.alias("school_id"),
        F.when(F.pmod(q, F.lit(6)) < 5, pick(sch.REQUEST_STATUSES, F.pmod(q, F.lit(6)))).alias("status"),
        null_s.alias("message"),
        F.when(F.pmod(eid, F.lit(2)) == 1, F.concat(F.lit("Reviewed "), eid.cast("string"))).alias("admin_notes"),
        "ts")
    stray = p.filter(F.pmod(eid, F.lit(13)) == 0).select(
        (eid * 4 + 3).alias("seq"), F.lit("set_status").alias("kind"), (eid + 1).alias("request_id"),
        null_l.alias("teacher_id"), null_l.alias("school_id"), F.lit("CLOSED").alias("status"),
        null_s.alias("message"), null_s.alias("admin_notes"), "ts")
    closes = p.filter(F.pmod(eid, F.lit(11)) == 0).select(
        (eid * 4 + 2).alias("seq"), F.lit("close").alias("kind"), eid.alias("request_id"),
        F.col("k").alias("teacher_id"),
        F.when(F.pmod(eid, F.lit(2)) == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("school_id"),
        null_s.alias("status"), null_s.alias("message"), null_s.alias("admin_notes"), "ts")
    return creates.unionByName(sets).unionByName(stray).unionByName(closes)


def delete_ids(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "delete_ids")
    return f.select("seq", _unknown_if(F.pmod(F.col("n"), F.lit(10)) == 9, F.col("k")).alias("id"), "ts")


def cancel_ids(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "cancel_ids")
    return f.select("seq", _unknown_if(F.pmod(F.col("n"), F.lit(10)) == 9, F.col("user_id")).alias("id"), "ts")


def code_ops(spark, sf_dir) -> DataFrame:
    f = feed_events(spark, sf_dir, "code_maintenance")
    m, k = F.pmod(F.col("n"), F.lit(4)), F.col("k")
    code = (F.when(m == 0, F.concat(F.lit("N"), F.expr("n div 8").cast("string")))
            .when(m == 1, F.concat(F.lit("C"), (k * 20).cast("string")))
            .when(m == 2, F.lit("")))
    return f.select("seq", F.when(m == 3, F.lit("expire")).otherwise(F.lit("create")).alias("op"),
                    code.alias("code"),
                    F.when(m == 3, F.concat(F.lit("C"), (F.col("event_id") - 3).cast("string"))).alias("id"),
                    "ts")


def teacher_sheet(spark, sf_dir) -> DataFrame:
    """An exported teacher sheet with messy cells, one row per part."""
    p = read(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    code = (F.when(F.pmod(key, F.lit(13)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(key, F.lit(17)) == 0, F.concat(F.lit("T-"), padded(key, 5)))
            .otherwise(F.concat(F.lit("I-"), F.expr("p_partkey div 2").cast("string"))))
    null = F.lit(None).cast("string")
    return p.select(
        (key + 2).cast("int").alias("sheet_row"),
        code.alias("Teacher Code"),
        F.when(F.pmod(key, F.lit(19)) == 0, F.lit("")).otherwise(F.col("p_name")).alias("Full Name"),
        F.concat(F.lit("i"), key.cast("string"), F.lit("@example.org")).alias("Email"),
        null.alias("Phone"), null.alias("CV Link"), F.col("p_brand").alias("Job Title"),
        F.col("p_name").alias("Subjects"), F.col("p_type").alias("Highest Qualification"),
        F.concat(F.lit("Country "), F.pmod(size, F.lit(5)).cast("string")).alias("Country"),
        null.alias("Region"), null.alias("Visa Status"), null.alias("Notice Period"),
        null.alias("Preferred Regions"), null.alias("Current School"),
        F.concat(F.lit("Bio "), key.cast("string")).alias("Bio"),
        pick(["YES ", "no", None, "true", "1", "False"], F.pmod(key, F.lit(6))).alias("Will Move Sem 1"),
        pick(["Yes", "", None], F.pmod(size, F.lit(3))).alias("Will Move Sem 2"),
        pick(["TRUE", "no", None, "1"], F.pmod(size, F.lit(4))).alias("Visible in Portal"),
        pick(["12abc", "", "-3.9", " 7", "x", None], F.pmod(key, F.lit(6))).alias("Years Experience"),
        pick(["active", "", None, " Placed ", "bogus"], F.pmod(key, F.lit(5))).alias("Profile Status"),
    )


def teacher_sheet_files(spark, sf_dir) -> str:
    """``teacher_sheet`` exported as four CSV files without its row numbers, with quotes and line ends in the bios;
    returns the folder."""
    folder = scratch_path(spark, "sheet-files")
    bio = F.concat(F.lit('"Bio"\n'), F.substring("Bio", 5, 100))
    (teacher_sheet(spark, sf_dir).withColumn("Bio", bio).repartitionByRange(4, "sheet_row")
     .sortWithinPartitions("sheet_row").drop("sheet_row").write.csv(folder, header=True, escape='"'))
    return folder


def lower_cased(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.lower(c) for c in cols})


def restored_twice(df: DataFrame, *enums: str) -> DataFrame:
    """A table with every row once more, under a new id and with its enum values in lower case."""
    return df.unionByName(lower_cased(df.withColumn("id", F.col("id") + 1_000_000), *enums))

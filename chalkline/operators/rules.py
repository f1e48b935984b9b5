"""Classification and constraint reports over whole tables (Q13, Q14, Q16-Q19).

The reference evaluates these rules for one row at a time; here each rule is
a chained ``when`` over a whole table, first match wins, evaluated inside
whole-stage codegen. Feeds are joined to dimensions by key (AQE decides the
join strategy from measured sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.time import iso_utc, ts_lit
from chalkline.sources import schemas as sch

# Plan-change denial reasons.
REASON_MISSING_PLAN = "Missing planId"
REASON_HAS_BASIC = "You already have BASIC. You can only upgrade to PRO or ULTIMATE."
REASON_HAS_PRO = "You already have PRO. You can only upgrade to ULTIMATE."
REASON_HAS_ULTIMATE = "You already have ULTIMATE. You must cancel or let it expire before buying another plan."
REASON_UNKNOWN_PLAN = "Unknown current subscription plan."

# Entitlement outcome codes and the statuses that grant access.
SUBSCRIPTION_REQUIRED = "SUBSCRIPTION_REQUIRED"
SUBSCRIPTION_EXPIRED = "SUBSCRIPTION_EXPIRED"
ENTITLED_STATUSES = ["TRIAL", "ACTIVE"]

# Access-code check messages.
CODE_REQUIRED = "Code is required"
CODE_INVALID = "Invalid or already used access code"
CODE_VALID = "Access code is valid"


def subscription_status_report(schools: DataFrame) -> DataFrame:
    """Q13: status and ISO end date (null when there is none) per school."""
    return schools.select(F.col("id").alias("school_id"), "subscription_status",
                          iso_utc(F.col("subscription_end_at")).alias("subscription_end_at"))


def current_plan(schools: DataFrame, as_of) -> DataFrame:
    """A plan counts only while status is ACTIVE and the end is null or later than as_of."""
    active = (F.col("subscription_status") == "ACTIVE") & (
        F.col("subscription_end_at").isNull() | (F.col("subscription_end_at") > ts_lit(as_of)))
    return schools.select(F.col("id").alias("school_id"),
                          F.when(active, F.col("subscription_plan")).alias("current_plan"))


def plan_change_check(schools: DataFrame, wanted: DataFrame, as_of) -> DataFrame:
    """Q14: may each school buy the plan it asks for?

    ``wanted`` has (seq, school_id, requested_plan). A school without a
    current plan (or unknown to the table) may buy anything, even an unknown
    plan; a missing request is denied first.
    """
    cur = current_plan(schools, as_of)
    j = wanted.join(cur, "school_id", "left")
    req, plan = F.col("requested_plan"), F.col("current_plan")
    missing = req.isNull() | (req == "")
    reason = (F.when(missing, REASON_MISSING_PLAN)
              .when(plan.isNull(), None)
              .when(plan == "BASIC", F.when(req.isin("PRO", "ULTIMATE"), None).otherwise(REASON_HAS_BASIC))
              .when(plan == "PRO", F.when(req == "ULTIMATE", None).otherwise(REASON_HAS_PRO))
              .when(plan == "ULTIMATE", REASON_HAS_ULTIMATE)
              .otherwise(REASON_UNKNOWN_PLAN))
    return j.select("seq", "school_id", "requested_plan", "current_plan",
                    reason.isNull().alias("allowed"), reason.alias("reason"))


def entitlement_report(schools: DataFrame, as_of) -> DataFrame:
    """Q17: portal access per school; ``code`` is null when access is granted.

    In order: either date missing -> SUBSCRIPTION_REQUIRED; end strictly
    before as_of -> SUBSCRIPTION_EXPIRED; status not TRIAL/ACTIVE ->
    SUBSCRIPTION_REQUIRED.
    """
    start, end = F.col("subscription_started_at"), F.col("subscription_end_at")
    code = (F.when(start.isNull() | end.isNull(), SUBSCRIPTION_REQUIRED)
            .when(end < ts_lit(as_of), SUBSCRIPTION_EXPIRED)
            .when(~F.col("subscription_status").isin(*ENTITLED_STATUSES), SUBSCRIPTION_REQUIRED))
    return schools.select(F.col("id").alias("school_id"), code.isNull().alias("allowed"), code.alias("code"))


def access_code_check(attempts: DataFrame, access_codes: DataFrame) -> DataFrame:
    """Q18: is each attempted code usable (exists and UNUSED)?

    The unused codes are reduced to distinct keys before the join, so a
    duplicated code (a broken UNIQUE constraint) cannot multiply attempts;
    the aggregate and the join share the same hash partitioning on ``code``.
    """
    unused = (access_codes.filter(F.col("status") == "UNUSED").select("code").distinct()
              .withColumn("usable", F.lit(True)))
    j = attempts.join(unused, "code", "left")
    code = F.col("code")
    message = (F.when(code.isNull() | (code == ""), CODE_REQUIRED)
               .when(F.col("usable"), CODE_VALID).otherwise(CODE_INVALID))
    return j.select("seq", "code", F.coalesce("usable", F.lit(False)).alias("valid"), message.alias("message"))


def view_log(views: DataFrame, teacher_ids=None, school_ids=None) -> DataFrame:
    """Q19: the view log, optionally for given teachers/schools, oldest first."""
    v = views
    for col, ids in (("teacher_id", teacher_ids), ("school_id", school_ids)):
        if ids is None:
            continue
        if isinstance(ids, DataFrame):
            v = v.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi")
        else:
            v = v.filter(F.col(col).isin(list(ids)))
    return v.select("id", "teacher_id", "school_id", "viewed_at").orderBy("viewed_at", "id")


# ---- Q16: constraints -----------------------------------------------------------

def _candidates(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """One scan of ``df`` -> rows (check_name, k) for every (name, key, condition) that holds."""
    cells = [F.when(cond, F.struct(F.lit(name).alias("check_name"), key.cast("string").alias("k")))
             for name, key, cond in checks]
    return df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def _fk_candidates(df: DataFrame, checks: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Rows (check_name, target, k) for foreign keys; ``nullable`` FKs skip nulls."""
    cells = []
    for name, col, target, nullable in checks:
        s = F.struct(F.lit(name).alias("check_name"), F.lit(target).alias("target"), F.col(col).alias("k"))
        cells.append(F.when(F.col(col).isNotNull(), s) if nullable else s)
    return df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def _bad_enum(col: str, domain: list, nullable: bool) -> Column:
    c = F.col(col)
    bad = (c.isNotNull() & ~c.isin(*domain)) if nullable else (c.isNull() | ~c.isin(*domain))
    return F.coalesce(bad, F.lit(False))


UNIQUE_CHECKS = ["schools.email unique", "teachers.teacher_code unique", "access_codes.code unique"]
FK_CHECKS = ["requests.teacher_id references teachers", "requests.school_id references schools",
             "teacher_views.teacher_id references teachers", "teacher_views.school_id references schools",
             "access_codes.school_id references schools"]
ENUM_CHECKS = ["schools.subscription_status enum", "schools.subscription_plan enum",
               "teachers.profile_status enum", "access_codes.status enum", "requests.status enum"]


def constraint_report(schools: DataFrame, teachers: DataFrame, access_codes: DataFrame,
                      requests: DataFrame, views: DataFrame) -> DataFrame:
    """Q16: one row per declared constraint with the number of offending keys and rows.

    UNIQUE -> key groups with more than one row; FK -> anti join; ENUM ->
    values outside the domain. Each table is scanned once: its candidate
    violations are emitted as tagged (check, key) rows, the five foreign-key
    checks share one anti join on (target, key), and a single aggregate by
    (check, key) then by check produces the report. Offenders are reduced per
    key map-side, so the report stays small whatever the table size.
    """
    direct = (
        _candidates(schools, [
            ("schools.email unique", F.col("email"), F.col("email").isNotNull()),
            ("schools.subscription_status enum", F.col("subscription_status"),
             _bad_enum("subscription_status", sch.SUBSCRIPTION_STATUSES, False)),
            ("schools.subscription_plan enum", F.col("subscription_plan"),
             _bad_enum("subscription_plan", sch.SUBSCRIPTION_PLANS, True))])
        .unionByName(_candidates(teachers, [
            ("teachers.teacher_code unique", F.col("teacher_code"), F.col("teacher_code").isNotNull()),
            ("teachers.profile_status enum", F.col("profile_status"),
             _bad_enum("profile_status", sch.PROFILE_STATUSES, False))]))
        .unionByName(_candidates(access_codes, [
            ("access_codes.code unique", F.col("code"), F.col("code").isNotNull()),
            ("access_codes.status enum", F.col("status"), _bad_enum("status", sch.ACCESS_CODE_STATUSES, False))]))
        .unionByName(_candidates(requests, [
            ("requests.status enum", F.col("status"), _bad_enum("status", sch.REQUEST_STATUSES, False))])))
    fks = (_fk_candidates(requests, [("requests.teacher_id references teachers", "teacher_id", "t", False),
                                     ("requests.school_id references schools", "school_id", "s", False)])
           .unionByName(_fk_candidates(views, [
               ("teacher_views.teacher_id references teachers", "teacher_id", "t", False),
               ("teacher_views.school_id references schools", "school_id", "s", False)]))
           .unionByName(_fk_candidates(access_codes, [
               ("access_codes.school_id references schools", "school_id", "s", True)])))
    dims = (teachers.select(F.lit("t").alias("target"), F.col("id").alias("k"))
            .unionByName(schools.select(F.lit("s").alias("target"), F.col("id").alias("k"))))
    # count fact references per key first: the anti join then sees distinct keys only
    orphans = (fks.groupBy("check_name", "target", "k").agg(F.count(F.lit(1)).alias("n"))
               .join(dims, ["target", "k"], "left_anti")
               .select("check_name", F.col("k").cast("string").alias("k"), "n"))
    per_key = direct.groupBy("check_name", "k").agg(F.count(F.lit(1)).alias("n")).unionByName(orphans)
    offending = per_key.filter(~F.col("check_name").isin(*UNIQUE_CHECKS) | (F.col("n") > 1))
    found = offending.groupBy("check_name").agg(F.count(F.lit(1)).alias("violating_keys"),
                                                F.sum("n").cast("long").alias("violating_rows"))
    # fixed list of declared constraints, so a clean check still reports zero
    names = schools.sparkSession.createDataFrame([(n,) for n in UNIQUE_CHECKS + FK_CHECKS + ENUM_CHECKS],
                                                 "check_name string")
    return (names.join(found, "check_name", "left")
            .select("check_name", F.coalesce("violating_keys", F.lit(0)).cast("long").alias("violating_keys"),
                    F.coalesce("violating_rows", F.lit(0)).cast("long").alias("violating_rows")))

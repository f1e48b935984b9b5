"""Bulk change-feed jobs: ``(snapshot, feed, as_of) -> (new snapshot, rejects)``.

The reference applies single-row UPDATEs; here a whole feed is applied to an
immutable snapshot in one pass. Common shape:
  * validate the feed rows (``when`` chains) and split off rejects;
  * reduce the feed per key with aggregates (``max_by(value, seq)`` for the
    last write), which partially aggregate map-side so a hot key is merged
    before the shuffle;
  * join the reduced feed to the snapshot by key and rewrite columns with
    ``when/otherwise``.
Outputs are new DataFrames; callers write them to a new versioned path with
``chalkline.sources.tables.write_snapshot`` (never over the path being read).
"Now" is the feed row's own ``ts`` when present, else ``as_of``.
Rejects have columns (seq, key, reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import email_ok, normalise_email
from chalkline.functions.time import add_months_overflow, hours, ts_lit
from chalkline.operators.redeem import _stored
from chalkline.session import scratch_path
from chalkline.sources import schemas as sch
from chalkline.sources.tables import delete

# Reject reasons.
TEACHER_NOT_FOUND = "Teacher not found"
SCHOOL_NOT_FOUND = "School not found"
NO_FIELDS = "No valid fields provided"
EMAIL_IN_USE = "Email already in use"
STATUS_REQUIRED = "subscription_status is required"
BAD_STATUS = "Invalid subscription_status value"
HOURS_REQUIRED = "subscription_expires_at (hours) is required"
BAD_HOURS = "subscription_expires_at must be a positive number of hours"
PAYMENT_INCOMPLETE = "Payment not completed yet"
INVALID_PLAN = "Invalid plan"
PLAN_SCHOOL_MISMATCH = "School not found or update failed"
DUPLICATE_SESSION = "Duplicate checkout session"
REQUEST_NOT_FOUND = "Request not found"
DUPLICATE_REQUEST = "Duplicate request id"
REQUEST_CLOSE_DENIED = "Request not found or not authorized"
STATUS_NULL = "status is required"
CODE_REQUIRED = "Access code is required"
CODE_EXISTS = "Access code already exists"
CODE_NOT_FOUND = "Access code not found"
EMAIL_TAKEN = "School with this email already exists"
INVALID_INPUT = "Invalid input"
CONTACT_REQUIRED = "contact_name is required"
CODE_INVALID_OR_USED = "Invalid or used access code."

# Fixed value: message stored when a school sends a request without one.
DEFAULT_REQUEST_MESSAGE = "Interested in this teacher and would like to connect."

# Months bought by each paid plan.
PLAN_MONTHS = {"BASIC": 1, "PRO": 6, "ULTIMATE": 12}
OVERRIDE_STATUSES = ["TRIAL", "ACTIVE", "EXPIRED"]


def _now(df: DataFrame, as_of) -> Column:
    return F.col("ts") if "ts" in df.columns else ts_lit(as_of)


def _rejects(df: DataFrame, key: str, reason: Column) -> DataFrame:
    return df.select("seq", F.col(key).cast("string").alias("key"), reason.alias("reason"))


def _replace(snapshot: DataFrame, values: dict[str, Column]) -> list[Column]:
    return [values.get(c, F.col(c)).alias(c) for c in snapshot.columns]


# ---- M1 ------------------------------------------------------------------------

def expire_subscriptions(schools: DataFrame, as_of) -> DataFrame:
    """M1: end before as_of and status not EXPIRED -> EXPIRED (updated_at untouched).

    Idempotent: a second run changes nothing. Access codes are not touched.
    """
    due = (F.col("subscription_end_at") < ts_lit(as_of)) & (F.col("subscription_status") != "EXPIRED")
    return schools.select(_replace(schools, {
        "subscription_status": F.when(F.coalesce(due, F.lit(False)), F.lit("EXPIRED"))
                                .otherwise(F.col("subscription_status"))}))


# ---- M2 ------------------------------------------------------------------------

def archive_teachers(teachers: DataFrame, requests: DataFrame, views: DataFrame,
                     delete_ids: DataFrame, archived: DataFrame | None = None, as_of=None):
    """M2: delete teachers by id, copying each to the archive first.

    ``delete_ids`` has (seq, id[, ts]). The first delete of a known id wins;
    unknown ids and repeated deletes are rejected (the row is already gone).
    The archive row copies the profile columns (not bio/current_school_name)
    and both timestamps; archive_id continues after the existing maximum in
    seq order. Requests and views of deleted teachers are removed (cascade).
    Returns (archive_rows, teachers_left, requests_left, views_left, rejects).
    For the append-only view log, store ``deleted_teacher_ids(...)`` as
    tombstones (``sources.tables.append_tombstones``) rather than writing
    ``views_left``: readers apply them with an anti join.
    """
    d = delete_ids.select("seq", "id", _now(delete_ids, as_of).alias("ts"))
    first = d.groupBy("id").agg(F.min_by(F.struct("seq", "ts"), "seq").alias("f"))
    first = first.select("id", "f.seq", "f.ts")
    hit = first.join(teachers.select("id"), "id", "left_semi")
    start = 0
    if archived is not None:
        start = archived.agg(F.coalesce(F.max("archive_id"), F.lit(0))).first()[0]
    arch = (teachers.join(hit, "id")
            .select((F.lit(start) + F.col("seq") + 1).cast("long").alias("archive_id"),
                    F.col("id").alias("original_teacher_id"),
                    *sch.TEACHER_PROFILE_COLUMNS,
                    F.col("created_at").alias("original_created_at"),
                    F.col("updated_at").alias("original_updated_at"),
                    F.col("ts").alias("archived_at")))
    gone = hit.select("id")
    teachers_left = teachers.join(gone, "id", "left_anti")
    requests_left = requests.join(gone.withColumnRenamed("id", "teacher_id"), "teacher_id", "left_anti")
    views_left = views.join(gone.withColumnRenamed("id", "teacher_id"), "teacher_id", "left_anti")
    known = d.join(hit.select("id", F.col("seq").alias("_first")), "id", "left")
    rejects = _rejects(known.filter(F.col("_first").isNull() | (F.col("seq") != F.col("_first"))),
                       "id", F.lit(TEACHER_NOT_FOUND))
    return arch, teachers_left, requests_left, views_left, rejects


def deleted_teacher_ids(teachers: DataFrame, delete_ids: DataFrame) -> DataFrame:
    """Ids that an M2 run removes (known teachers named in the feed)."""
    return delete_ids.select("id").distinct().join(teachers.select("id"), "id", "left_semi")


# ---- M3 / M4: patches ------------------------------------------------------------

def _explode_patch(feed: DataFrame) -> DataFrame:
    """(seq, id, ts, changes map) -> one row per (seq, id, field, value); an empty
    map keeps one row with a null field so the patch still counts as applied."""
    return feed.select("seq", "id", "ts", F.explode_outer("changes").alias("field", "value"))


def _last_values(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Per id, one aggregate: for each field whether it was set and its last
    value by seq, plus ``_ts`` = time of the last applied patch."""
    aggs = [F.max_by("ts", "seq").alias("_ts")]
    for f in fields:
        is_f = F.col("field") == f
        aggs.append(F.max(is_f.cast("int")).alias(f"_set_{f}"))
        aggs.append(F.max_by(F.col("value"), F.when(is_f, F.col("seq"))).alias(f"_val_{f}"))
    return cells.groupBy("id").agg(*aggs)


def _typed(value: Column, dtype) -> Column:
    if isinstance(dtype, type(sch.B)):
        return F.lower(F.trim(value)).try_cast("boolean")
    if isinstance(dtype, type(sch.I)):
        return value.try_cast("int")
    return value.cast(dtype)


INVALID_VALUE = "Invalid value for a column"
INVALID_STATUS = "Invalid request status"

# NOT NULL columns a patch may touch; writing null to them fails the update.
TEACHER_NOT_NULL = ["full_name", "email", "will_move_sem1", "will_move_sem2", "profile_status",
                    "is_visible_in_school_portal"]
SCHOOL_NOT_NULL = ["name", "contact_name", "email"]


def _bad_patch(changes: Column, not_null: list[str], enums: dict[str, list], ints: list[str],
               bools: list[str]) -> Column:
    """True when a patch would make the database refuse the whole update."""
    conds = []
    for k in not_null:
        conds.append(F.map_contains_key(changes, k) & changes.getItem(k).isNull())
    for k, domain in enums.items():
        conds.append(changes.getItem(k).isNotNull() & ~changes.getItem(k).isin(*domain))
    for k in ints:
        conds.append(changes.getItem(k).isNotNull() & changes.getItem(k).try_cast("int").isNull())
    for k in bools:
        conds.append(changes.getItem(k).isNotNull() & F.lower(F.trim(changes.getItem(k))).try_cast("boolean").isNull())
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def apply_teacher_patches(teachers: DataFrame, patches: DataFrame, as_of=None):
    """M3: ``patches`` (seq, id, changes map<string,string>[, ts]).

    An absent key keeps the old value, a key with a null value writes null;
    the last patch (by seq) per (id, field) wins; teacher_code and unknown
    keys are ignored. updated_at = time of the last patch (an empty patch
    still touches it). Unknown id -> reject; a patch the database would
    refuse (null in a NOT NULL column, a status outside the enum, a
    non-integer year count or non-boolean flag) is rejected whole.
    Returns (new_teachers, rejects).
    """
    p = patches.select("seq", "id", "changes", _now(patches, as_of).alias("ts"))
    ids = teachers.select("id")
    bad = _bad_patch(F.col("changes"), TEACHER_NOT_NULL, {"profile_status": sch.PROFILE_STATUSES},
                     ["years_experience"], ["will_move_sem1", "will_move_sem2", "is_visible_in_school_portal"])
    rejects = (_rejects(p.join(ids, "id", "left_anti"), "id", F.lit(TEACHER_NOT_FOUND))
               .unionByName(_rejects(p.join(ids, "id", "left_semi").filter(bad), "id", F.lit(INVALID_VALUE))))
    fields = list(sch.TEACHER_PATCHABLE)
    last = _last_values(_explode_patch(p.join(ids, "id", "left_semi").filter(~bad)), fields)
    j = teachers.join(last, "id", "left")
    types = {f.name: f.dataType for f in sch.TEACHERS.fields}
    values = {f: F.when(F.col(f"_set_{f}") == 1, _typed(F.col(f"_val_{f}"), types[f])).otherwise(F.col(f))
              for f in fields}
    values["updated_at"] = F.coalesce(F.col("_ts"), F.col("updated_at"))
    return j.select(_replace(teachers, values)), rejects


def apply_school_patches(schools: DataFrame, patches: DataFrame, as_of=None):
    """M4: ``patches`` (seq, id, changes map<string,string>[, ts]).

    Keys: name, contact_name, email, website, description (-> about), phone,
    address, city, country, region. An empty patch is rejected. A patch
    whose email belongs to another school in the snapshot, or was claimed by
    an earlier patch of another school in this batch, is rejected whole.
    (An address freed within the batch becomes available in the next one.)
    Returns (new_schools, rejects).

    Plan: the feed meets the snapshot in two key joins (id, email); owners
    and batch claims come from one aggregate by address; the accepted cells
    are reduced per id in one aggregate before the final join.
    """
    keys = list(sch.SCHOOL_PATCHABLE)
    p = patches.select(
        "seq", "id", "changes", _now(patches, as_of).alias("ts"),
        F.size(F.filter(F.map_keys("changes"), lambda k: k.isin(*keys))).alias("_nkeys"),
        F.col("changes").getItem("email").alias("_email"),
        F.map_contains_key("changes", "email").alias("_has_email"),
        _bad_patch(F.col("changes"), SCHOOL_NOT_NULL, {}, [], []).alias("_bad"))
    known = schools.select(F.col("id"), F.lit(True).alias("_known"))
    p = p.join(known, "id", "left")
    # one aggregate per address: snapshot owners (min/max id, so a duplicated
    # address still counts as taken) and the first claim of this batch. The
    # claimer matters only for addresses nobody owns: on an owned address every
    # other school's patch is already "taken".
    cand = (p.filter(F.col("_known").isNotNull() & (F.col("_nkeys") > 0) & ~F.col("_bad")
                     & F.col("_has_email") & F.col("_email").isNotNull())
            .select("_email", "id", "seq", F.lit(False).alias("_snap")))
    snap = schools.select(F.col("email").alias("_email"), "id", F.lit(None).cast("long").alias("seq"),
                          F.lit(True).alias("_snap"))
    per_email = cand.unionByName(snap).groupBy("_email").agg(
        F.min(F.when(F.col("_snap"), F.col("id"))).alias("_own_min"),
        F.max(F.when(F.col("_snap"), F.col("id"))).alias("_own_max"),
        F.min_by(F.col("id"), F.when(~F.col("_snap"), F.col("seq"))).alias("_claimer"))
    p = p.join(per_email, "_email", "left")
    taken = F.col("_has_email") & F.col("_own_min").isNotNull() & (
        (F.col("_own_min") != F.col("id")) | (F.col("_own_max") != F.col("id")))
    p = p.withColumn("_taken", F.coalesce(taken, F.lit(False)))
    lost = (F.col("_has_email") & F.col("_own_min").isNull() & F.col("_claimer").isNotNull()
            & (F.col("_claimer") != F.col("id")))
    reason = (F.when(F.col("_known").isNull(), SCHOOL_NOT_FOUND)
              .when(F.col("_nkeys") == 0, NO_FIELDS)
              .when(F.col("_taken") | lost, EMAIL_IN_USE)
              .when(F.col("_bad"), INVALID_VALUE))
    p = p.withColumn("_reason", reason)
    rejects = _rejects(p.filter(F.col("_reason").isNotNull()), "id", F.col("_reason"))
    ok = p.filter(F.col("_reason").isNull()).select("seq", "id", "ts", "changes")
    last = _last_values(_explode_patch(ok), keys)
    j = schools.join(last, "id", "left")
    values = {}
    for k, col in sch.SCHOOL_PATCHABLE.items():
        values[col] = F.when(F.col(f"_set_{k}") == 1, F.col(f"_val_{k}")).otherwise(F.col(col))
    values["updated_at"] = F.coalesce(F.col("_ts"), F.col("updated_at"))
    return j.select(_replace(schools, values)), rejects


# ---- M6 --------------------------------------------------------------------------

def register_schools(schools: DataFrame, signups: DataFrame, codes: DataFrame | None = None, as_of=None):
    """M6: ``signups`` (seq, name, contact_name, email, country, region, access_code[, ts]).

    Validation: name 1..200 chars, email well formed, contact_name present
    (NOT NULL column). The address is trimmed and lower-cased; an address
    already in the snapshot or taken by an earlier successful signup is
    rejected. With a code, the code must be UNUSED and not consumed by an
    earlier successful signup; the school then starts a 24-hour trial and
    the code becomes ACTIVE. Email and code are claimed only on success, so
    the batch answer comes from ``greedy_match`` on (email, code).
    New ids continue after the snapshot maximum in seq order.
    Returns (inserted, rejects, new_codes).
    """
    from chalkline.operators.redeem import activate_codes, greedy_match

    s = signups.select("seq", "name", "contact_name", "email", "country", "region", "access_code",
                       _now(signups, as_of).alias("ts"))
    s = s.withColumn("_email", normalise_email(F.col("email")))
    valid = (F.col("name").isNotNull() & (F.length("name") >= 1) & (F.length("name") <= 200)
             & F.col("email").isNotNull() & email_ok(F.col("email")))
    existing = schools.select(F.lower(F.trim("email")).alias("_email")).distinct().withColumn("_exists", F.lit(True))
    s = s.join(existing, "_email", "left")
    has_code = F.col("access_code").isNotNull() & (F.col("access_code") != "")
    if codes is not None:
        unused = (codes.filter(F.col("status") == "UNUSED").select(F.col("code").alias("access_code"))
                  .distinct().withColumn("_unused", F.lit(True)))
        s = s.join(unused, "access_code", "left")
    else:
        s = s.withColumn("_unused", F.lit(None).cast("boolean"))
    static_ok = (valid & F.col("contact_name").isNotNull() & F.col("_exists").isNull()
                 & (~has_code | F.col("_unused").isNotNull()))
    s = s.withColumn("_static_ok", F.coalesce(static_ok, F.lit(False)))
    s = s.withColumn("_code", F.when(has_code, F.col("access_code")))
    won = greedy_match(s.filter("_static_ok").select("seq", "_email", "_code"), "_email", "_code")
    by_email = won.select("_email", F.col("seq").alias("_email_seq"))
    by_code = won.filter(F.col("_code").isNotNull()).select("_code", F.col("seq").alias("_code_seq"))
    r = s.join(by_email, "_email", "left").join(by_code, "_code", "left")
    seq = F.col("seq")
    reason = (F.when(~F.coalesce(valid, F.lit(False)), INVALID_INPUT)
              .when(F.col("contact_name").isNull(), CONTACT_REQUIRED)
              .when(F.col("_exists") | (F.col("_email_seq") < seq), EMAIL_TAKEN)
              .when(has_code & (F.col("_unused").isNull() | (F.col("_code_seq") < seq)), CODE_INVALID_OR_USED))
    r = r.withColumn("_reason", reason)
    rejects = _rejects(r.filter(F.col("_reason").isNotNull()), "_email", F.col("_reason"))
    ok = r.filter(F.col("_reason").isNull())
    start = schools.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    trial = F.col("_code").isNotNull()
    inserted = ok.select(
        (F.lit(start) + 1 + F.col("seq")).cast("long").alias("id"),
        "name", "contact_name", F.col("_email").alias("email"),
        F.lit(None).cast("string").alias("website"), "country", "region",
        *[F.lit(None).cast("string").alias(c) for c in ("about", "phone", "city", "address")],
        F.when(trial, F.lit("TRIAL")).otherwise(F.lit("NO_SUBSCRIPTION")).alias("subscription_status"),
        F.lit(None).cast("string").alias("subscription_plan"),
        F.when(trial, F.col("ts")).alias("subscription_started_at"),
        F.when(trial, F.col("ts") + hours(24)).alias("subscription_end_at"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.lit(False).alias("verified"))
    new_codes = None
    if codes is not None:
        used = ok.filter(trial).select(F.col("_code").alias("code"),
                                       (F.lit(start) + 1 + F.col("seq")).cast("long").alias("school_id"), "ts")
        new_codes = activate_codes(codes, used)
    return inserted, rejects, new_codes


# ---- M7 --------------------------------------------------------------------------

def activate_paid_plans(schools: DataFrame, checkouts: DataFrame, as_of=None):
    """M7: ``checkouts`` (seq, session_id, school_id, email, plan, payment_status[, ts]).

    One event per session: the first by seq that passes all other checks, so
    a session that is first unpaid and then paid is activated; later ones that
    pass are replays and rejected. Only 'paid'; BASIC/PRO/ULTIMATE buy 1/6/12 months from the event time with
    month-end overflow; the school must match id *and* email. Success sets
    status ACTIVE, the plan, started and end (updated_at untouched); the last
    success per school wins. Returns (new_schools, rejects).
    """
    c = checkouts.select("seq", "session_id", "school_id", "email", "plan", "payment_status",
                         _now(checkouts, as_of).alias("ts"))
    match = schools.select(F.col("id").alias("school_id"), "email").distinct().withColumn("_match", F.lit(True))
    c = c.join(match, ["school_id", "email"], "left")
    months = F.create_map(*[x for k, v in PLAN_MONTHS.items() for x in (F.lit(k), F.lit(v))])
    n = months[F.col("plan")]
    refused = (F.when(F.coalesce(F.col("payment_status"), F.lit("")) != "paid", PAYMENT_INCOMPLETE)
               .when(~F.coalesce(F.col("plan").isin(*PLAN_MONTHS), F.lit(False)), INVALID_PLAN)
               .when(F.col("_match").isNull(), PLAN_SCHOOL_MISMATCH))
    c = c.withColumn("_refused", refused)
    first = c.filter(F.col("_refused").isNull()).groupBy("session_id").agg(F.min("seq").alias("_first"))
    first = first.withColumnRenamed("session_id", "_session")
    c = c.join(first, F.col("session_id").eqNullSafe(F.col("_session")), "left")
    c = c.withColumn("_reason", F.coalesce("_refused", F.when(F.col("seq") != F.col("_first"), DUPLICATE_SESSION)))
    rejects = _rejects(c.filter(F.col("_reason").isNotNull()), "school_id", F.col("_reason"))
    ok = c.filter(F.col("_reason").isNull()).withColumn("_end", add_months_overflow(F.col("ts"), n))
    last = (ok.groupBy("school_id")
            .agg(F.max_by(F.struct("plan", "ts", "_end"), "seq").alias("w"))
            .select(F.col("school_id").alias("id"), F.col("w.plan").alias("_plan"),
                    F.col("w.ts").alias("_ts"), F.col("w._end").alias("_end")))
    j = schools.join(last, "id", "left")
    hit = F.col("_ts").isNotNull()
    new = j.select(_replace(schools, {
        "subscription_status": F.when(hit, F.lit("ACTIVE")).otherwise(F.col("subscription_status")),
        "subscription_plan": F.when(hit, F.col("_plan")).otherwise(F.col("subscription_plan")),
        "subscription_started_at": F.when(hit, F.col("_ts")).otherwise(F.col("subscription_started_at")),
        "subscription_end_at": F.when(hit, F.col("_end")).otherwise(F.col("subscription_end_at")),
    }))
    return new, rejects


# ---- M8 --------------------------------------------------------------------------

def override_subscription(schools: DataFrame, overrides: DataFrame, as_of=None):
    """M8: ``overrides`` (seq, school_id, status, hours[, ts]).

    status must be TRIAL/ACTIVE/EXPIRED, hours > 0; the school must exist.
    started = now, end = now + hours, updated_at = now; plan untouched. The
    last valid override per school wins. Returns (new_schools, rejects).
    """
    o = overrides.select("seq", "school_id", "status", "hours", _now(overrides, as_of).alias("ts"))
    o = o.join(schools.select(F.col("id").alias("school_id")).withColumn("_known", F.lit(True)),
               "school_id", "left")
    reason = (F.when(F.col("status").isNull() | (F.col("status") == ""), STATUS_REQUIRED)
              .when(~F.col("status").isin(*OVERRIDE_STATUSES), BAD_STATUS)
              .when(F.col("hours").isNull() | (F.col("hours") == 0), HOURS_REQUIRED)
              .when(F.col("hours") < 0, BAD_HOURS)
              .when(F.col("_known").isNull(), SCHOOL_NOT_FOUND))
    o = o.withColumn("_reason", reason)
    rejects = _rejects(o.filter(F.col("_reason").isNotNull()), "school_id", F.col("_reason"))
    last = (o.filter(F.col("_reason").isNull()).groupBy("school_id")
            .agg(F.max_by(F.struct("status", "hours", "ts"), "seq").alias("w"))
            .select(F.col("school_id").alias("id"), F.col("w.status").alias("_st"),
                    F.col("w.hours").alias("_h"), F.col("w.ts").alias("_ts")))
    j = schools.join(last, "id", "left")
    hit = F.col("_ts").isNotNull()
    new = j.select(_replace(schools, {
        "subscription_status": F.when(hit, F.col("_st")).otherwise(F.col("subscription_status")),
        "subscription_started_at": F.when(hit, F.col("_ts")).otherwise(F.col("subscription_started_at")),
        "subscription_end_at": F.when(hit, F.col("_ts") + hours(F.col("_h").cast("int")))
                                .otherwise(F.col("subscription_end_at")),
        "updated_at": F.when(hit, F.col("_ts")).otherwise(F.col("updated_at")),
    }))
    return new, rejects


# ---- M9 --------------------------------------------------------------------------

def cancel_subscriptions(schools: DataFrame, codes: DataFrame, cancels: DataFrame, as_of=None):
    """M9: ``cancels`` (seq, id[, ts]). The school goes to NO_SUBSCRIPTION with
    no plan and end = cancel time (last cancel wins); all its codes EXPIRE.
    Unknown school -> reject. Returns (new_schools, new_codes, rejects)."""
    c = cancels.select("seq", "id", _now(cancels, as_of).alias("ts"))
    known = c.join(schools.select("id"), "id", "left_semi")
    rejects = _rejects(c.join(schools.select("id"), "id", "left_anti"), "id", F.lit(SCHOOL_NOT_FOUND))
    last = known.groupBy("id").agg(F.max_by("ts", "seq").alias("_ts"))
    j = schools.join(last, "id", "left")
    hit = F.col("_ts").isNotNull()
    new_schools = j.select(_replace(schools, {
        "subscription_status": F.when(hit, F.lit("NO_SUBSCRIPTION")).otherwise(F.col("subscription_status")),
        "subscription_plan": F.when(hit, F.lit(None)).otherwise(F.col("subscription_plan")),
        "subscription_end_at": F.when(hit, F.col("_ts")).otherwise(F.col("subscription_end_at")),
    }))
    gone = last.select(F.col("id").alias("school_id"), F.lit(True).alias("_cancel"))
    cj = codes.join(gone, "school_id", "left")
    new_codes = cj.select(_replace(codes, {
        "status": F.when(F.col("_cancel").isNotNull(), F.lit("EXPIRED")).otherwise(F.col("status"))}))
    return new_schools, new_codes, rejects


# ---- M10 -------------------------------------------------------------------------

#: Types of the feed's columns, for those that a feed leaves untyped (a bare NULL).
_REQUEST_FEED = {"seq": "long", "kind": "string", "request_id": "long", "teacher_id": "long", "school_id": "long",
                 "status": "string", "message": "string", "admin_notes": "string"}


def _typed_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``df`` with its untyped columns typed, so that it can be written."""
    void = [c for c, kind in df.dtypes if kind == "void"]
    return df.withColumns({c: F.col(c).cast(types[c]) for c in void}) if void else df


def _judged_creates(creates: DataFrame, held: DataFrame, teachers: DataFrame | None,
                    schools: DataFrame | None, folder: str) -> DataFrame:
    """``creates`` with ``_reason``: unknown teacher, unknown school, or an id that is taken (the first by seq of
    the otherwise valid creates has it). Stored below ``folder``."""
    for table, key in ((teachers, "teacher_id"), (schools, "school_id")):
        flag = F.lit(True).alias(f"_has_{key}")
        if table is None:
            creates = creates.withColumn(f"_has_{key}", F.lit(True))
        else:
            creates = creates.join(table.select(F.col("id").alias(key)).distinct().select(key, flag), key, "left")
    taken = held.select(F.col("id").alias("request_id"), F.lit(True).alias("_taken"))
    refused = (F.when(F.col("_has_teacher_id").isNull(), TEACHER_NOT_FOUND)
               .when(F.col("_has_school_id").isNull(), SCHOOL_NOT_FOUND)
               .when(F.col("_taken").isNotNull(), DUPLICATE_REQUEST))
    row = ["seq", "request_id", "teacher_id", "school_id", "message", "ts"]
    creates = _stored(creates.join(taken, "request_id", "left").select(*row, refused.alias("_refused")),
                      f"{folder}/refused")
    first = creates.filter(F.col("_refused").isNull()).groupBy("request_id").agg(F.min("seq").alias("_first"))
    reason = F.coalesce("_refused", F.when(F.col("seq") != F.col("_first"), DUPLICATE_REQUEST))
    judged = _stored(creates.join(first, "request_id", "left").select(*row, reason.alias("_reason")),
                     f"{folder}/creates")
    delete(creates.sparkSession, f"{folder}/refused")
    return judged


def apply_request_events(requests: DataFrame, events: DataFrame, as_of=None, teachers: DataFrame | None = None,
                         schools: DataFrame | None = None):
    """M10: ``events`` (seq, kind, request_id, teacher_id, school_id, status,
    message, admin_notes[, ts]) with kind in create / set_status / close.

    create: a new PENDING request (its id is request_id), message defaults
    when empty; it exists for later events only. A create is rejected if its
    teacher or school is not in ``teachers`` / ``schools`` (where given) or its
    request_id is taken by a stored request or an earlier accepted create. set_status: any status to any status,
    admin_notes null -> ''; null status is refused. close: must match id,
    teacher_id and school_id, sets CLOSED. Invalid events are dropped to
    rejects *before* the fold; then per request the last status event (by
    seq) decides status, the last set_status decides admin_notes.
    Returns (new_requests, rejects).
    """
    _, created, folded, rejects = _judged_request_events(requests.select("id", "teacher_id", "school_id"), events,
                                                         as_of, teachers, schools)
    base = requests.unionByName(created)
    return _with_events(base, base.join(folded, "id", "left")), rejects


def changed_requests(requests: DataFrame, events: DataFrame, as_of=None, teachers: DataFrame | None = None,
                     schools: DataFrame | None = None):
    """M10 as a delta: the new rows of created and changed requests only, and the rejects.

    The same judgement and fold as ``apply_request_events``; rows that the feed does not name are read (the id column)
    but neither joined nor returned. ``sources.runs.Run.change`` stores the rows over the snapshot.
    """
    own = requests.select(*[f.name for f in sch.REQUESTS.fields])
    held, created, folded, rejects = _judged_request_events(own, events, as_of, teachers, schools)
    base = held.select(created.columns).unionByName(created.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    named = base.join(folded.withColumn("_hit", F.lit(True)), "id", "left").filter("_new or _hit")
    return _with_events(created, named), rejects


def _with_events(like: DataFrame, j: DataFrame) -> DataFrame:
    """Requests joined to the folded events, with status and notes replaced where an event says so."""
    return j.select(_replace(like, {
        "status": F.coalesce(F.col("_st"), F.col("status")),
        "admin_notes": F.when(F.col("_has_set") == 1, F.col("_nt")).otherwise(F.col("admin_notes")),
    }))


def _judged_request_events(requests: DataFrame, events: DataFrame, as_of, teachers: DataFrame | None,
                           schools: DataFrame | None):
    """The stored requests that the feed names, new requests, the last accepted event per request, and rejects.

    Each step is written below ``spark.checkpoint.dir`` and read again: all of them meet on the request id, so as one
    plan they would run, some several times over, in the same tasks, and a task would hold the sorts of all the joins.
    """
    spark = events.sparkSession
    folder = scratch_path(spark, "request-events")
    e = _stored(_typed_columns(events.select(*_REQUEST_FEED, _now(events, as_of).alias("ts")),
                               {**_REQUEST_FEED, "ts": "timestamp_ntz"}), f"{folder}/feed")
    # only the requests that the feed names are looked up, never the whole fact
    requests = _typed_columns(requests, {f.name: f.dataType.simpleString() for f in sch.REQUESTS.fields})
    named = _stored(requests.join(e.select(F.col("request_id").alias("id")).distinct(), "id", "left_semi"),
                    f"{folder}/named")
    held = named.select("id", F.col("teacher_id").alias("_tid"), F.col("school_id").alias("_sid"))
    made = _judged_creates(e.filter(F.col("kind") == "create"), held, teachers, schools, folder)
    creates = made.filter(F.col("_reason").isNull())
    created = creates.select(
        F.col("request_id").alias("id"), "teacher_id", "school_id", F.col("ts").alias("requested_at"),
        F.lit("PENDING").alias("status"),
        F.when(F.coalesce(F.col("message"), F.lit("")) == "", F.lit(DEFAULT_REQUEST_MESSAGE))
         .otherwise(F.col("message")).alias("school_message"),
        F.lit(None).cast("string").alias("admin_notes"))
    # a request created in this batch exists only for events after its create
    keys = held.withColumn("_born", F.lit(None).cast("long")).unionByName(
        creates.select(F.col("request_id").alias("id"), F.col("teacher_id").alias("_tid"),
                       F.col("school_id").alias("_sid"), F.col("seq").alias("_born")))
    upd = e.filter(F.col("kind") != "create").join(keys, F.col("request_id") == F.col("id"), "left")
    missing = F.col("id").isNull() | (F.col("_born").isNotNull() & (F.col("_born") > F.col("seq")))
    reason = (F.when(missing,
                     F.when(F.col("kind") == "close", REQUEST_CLOSE_DENIED).otherwise(REQUEST_NOT_FOUND))
              .when((F.col("kind") == "close")
                    & ~F.coalesce((F.col("teacher_id") == F.col("_tid")) & (F.col("school_id") == F.col("_sid")),
                                  F.lit(False)),
                    REQUEST_CLOSE_DENIED)
              .when((F.col("kind") == "set_status") & F.col("status").isNull(), STATUS_NULL)
              .when((F.col("kind") == "set_status") & ~F.col("status").isin(*sch.REQUEST_STATUSES), INVALID_STATUS)
              .when(~F.col("kind").isin("set_status", "close"), F.lit("unknown event kind")))
    upd = _stored(upd.select("seq", "kind", "request_id", "status", "admin_notes", reason.alias("_reason")),
                  f"{folder}/updates")
    delete(spark, f"{folder}/feed")
    rejects = (_rejects(upd.filter(F.col("_reason").isNotNull()), "request_id", F.col("_reason"))
               .unionByName(_rejects(made.filter(F.col("_reason").isNotNull()), "request_id", F.col("_reason"))))
    ok = upd.filter(F.col("_reason").isNull())
    new_status = F.when(F.col("kind") == "close", F.lit("CLOSED")).otherwise(F.col("status"))
    notes = F.when(F.col("kind") == "set_status", F.coalesce(F.col("admin_notes"), F.lit("")))
    folded = (ok.select(F.col("request_id").alias("id"), "seq", "kind", new_status.alias("_st"), notes.alias("_nt"))
              .groupBy("id")
              .agg(F.max_by("_st", "seq").alias("_st"),
                   F.max_by("_nt", F.when(F.col("kind") == "set_status", F.col("seq"))).alias("_nt"),
                   F.max((F.col("kind") == "set_status").cast("int")).alias("_has_set")))
    return named, created, folded, rejects


# ---- M11 -------------------------------------------------------------------------

def maintain_access_codes(codes: DataFrame, ops: DataFrame, as_of=None):
    """M11: ``ops`` (seq, op, code, id[, ts]); op create / expire.

    create: the code must be a non-empty string not already present (in the
    snapshot or created earlier in the batch); the new code is UNUSED, has no
    school and its id is derived from the code. expire: status -> EXPIRED by
    id; the id must exist in the snapshot or have been created by an earlier
    op. Returns (new_codes, rejects).

    Plan: one aggregate by code answers "already exists / first create" for
    every create; one aggregate by id gives each id's earliest existence
    (snapshot = -inf, else the seq of the create that made it), which decides
    every expire.
    """
    o = ops.select("seq", "op", "code", "id", _now(ops, as_of).alias("ts"))
    cr = o.filter(F.col("op") == "create")
    blank = F.col("code").isNull() | (F.col("code") == "")
    by_code = (codes.select("code", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("_snap"))
               .unionByName(cr.filter(~blank).select("code", "seq", F.lit(0).alias("_snap")))
               .groupBy("code").agg(F.max("_snap").alias("_in_snap"), F.min("seq").alias("_first")))
    cr = cr.join(by_code, "code", "left")
    c_reason = (F.when(blank, CODE_REQUIRED)
                .when((F.col("_in_snap") == 1) | (F.col("seq") != F.col("_first")), CODE_EXISTS))
    cr = cr.withColumn("_reason", c_reason)
    made = cr.filter(F.col("_reason").isNull())
    new_rows = made.select(
        F.col("code").alias("id"), "code", F.lit(None).cast("long").alias("school_id"),
        F.lit("UNUSED").alias("status"), F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("first_used_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    base = codes.unionByName(new_rows)
    born = (codes.select("id", F.lit(-1).cast("long").alias("_born"))
            .unionByName(made.select(F.col("code").alias("id"), F.col("seq").alias("_born")))
            .groupBy("id").agg(F.min("_born").alias("_born")))
    ex = o.filter(F.col("op") == "expire").join(born, "id", "left")
    e_reason = F.when(~F.coalesce(F.col("_born") < F.col("seq"), F.lit(False)), CODE_NOT_FOUND)
    ex = ex.withColumn("_reason", e_reason)
    rejects = (_rejects(cr.filter(F.col("_reason").isNotNull()), "code", F.col("_reason"))
               .unionByName(_rejects(ex.filter(F.col("_reason").isNotNull()), "id", F.col("_reason"))))
    expired = (ex.filter(F.col("_reason").isNull()).groupBy("id").agg(F.lit(True).alias("_exp")))
    j = base.join(expired, "id", "left")
    new = j.select(_replace(base, {
        "status": F.when(F.col("_exp").isNotNull(), F.lit("EXPIRED")).otherwise(F.col("status"))}))
    return new, rejects

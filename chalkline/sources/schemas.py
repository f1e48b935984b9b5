"""Domain table schemas and enum domains (from the reference DDL).

Timestamps are ``TIMESTAMP_NTZ``: the fixture parquet stores naive
microsecond timestamps, and every job takes an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Enum domains in declaration order (order matters for the
# plan ladder and for the fixture bindings).
PROFILE_STATUSES = ["ACTIVE", "INACTIVE", "PLACED"]
SUBSCRIPTION_STATUSES = ["NO_SUBSCRIPTION", "TRIAL", "ACTIVE", "EXPIRED"]
SUBSCRIPTION_PLANS = ["BASIC", "PRO", "ULTIMATE"]
ACCESS_CODE_STATUSES = ["UNUSED", "ACTIVE", "EXPIRED"]
REQUEST_STATUSES = ["PENDING", "TEACHER_CONTACTED", "TEACHER_ACCEPTED", "TEACHER_DECLINED", "CLOSED"]

ENUMS = {
    ("schools", "subscription_status"): SUBSCRIPTION_STATUSES,
    ("schools", "subscription_plan"): SUBSCRIPTION_PLANS,
    ("teachers", "profile_status"): PROFILE_STATUSES,
    ("access_codes", "status"): ACCESS_CODE_STATUSES,
    ("requests", "status"): REQUEST_STATUSES,
}

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(cols):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


SCHOOLS = _struct([
    ("id", L, False), ("name", S, False), ("contact_name", S, False), ("email", S, False),
    ("website", S, True), ("country", S, True), ("region", S, True), ("about", S, True),
    ("phone", S, True), ("city", S, True), ("address", S, True),
    ("subscription_status", S, False), ("subscription_plan", S, True),
    ("subscription_started_at", TS, True), ("subscription_end_at", TS, True),
    ("created_at", TS, False), ("updated_at", TS, False), ("verified", B, True),
])

# profile columns copied to the archive (everything but bio and current_school_name)
TEACHER_PROFILE_COLUMNS = [
    "teacher_code", "full_name", "email", "phone", "cv_link", "current_job_title", "subjects",
    "highest_qualification", "current_country", "current_region", "visa_status", "notice_period",
    "will_move_sem1", "will_move_sem2", "years_experience", "preferred_regions",
    "profile_status", "is_visible_in_school_portal",
]

TEACHERS = _struct([
    ("id", L, False), ("teacher_code", S, False), ("full_name", S, False), ("email", S, False),
    ("phone", S, True), ("cv_link", S, True), ("current_job_title", S, True), ("subjects", S, True),
    ("highest_qualification", S, True), ("current_country", S, True), ("current_region", S, True),
    ("visa_status", S, True), ("notice_period", S, True),
    ("will_move_sem1", B, False), ("will_move_sem2", B, False), ("years_experience", I, True),
    ("preferred_regions", S, True), ("bio", S, True), ("current_school_name", S, True),
    ("profile_status", S, False), ("is_visible_in_school_portal", B, False),
    ("created_at", TS, False), ("updated_at", TS, False),
])

ARCHIVED_TEACHERS = _struct(
    [("archive_id", L, False), ("original_teacher_id", L, True)]
    + [(f.name, f.dataType, True) for f in TEACHERS.fields if f.name in TEACHER_PROFILE_COLUMNS]
    + [("original_created_at", TS, True), ("original_updated_at", TS, True), ("archived_at", TS, False)]
)

ACCESS_CODES = _struct([
    ("id", S, False), ("code", S, False), ("school_id", L, True), ("status", S, False),
    ("created_at", TS, False), ("first_used_at", TS, True), ("expires_at", TS, True),
])

REQUESTS = _struct([
    ("id", L, False), ("teacher_id", L, False), ("school_id", L, False), ("requested_at", TS, False),
    ("status", S, False), ("school_message", S, True), ("admin_notes", S, True),
])

TEACHER_VIEWS = _struct([
    ("id", L, False), ("teacher_id", L, False), ("school_id", L, False), ("viewed_at", TS, False),
])

TABLES = {
    "schools": SCHOOLS,
    "teachers": TEACHERS,
    "archived_teachers": ARCHIVED_TEACHERS,
    "access_codes": ACCESS_CODES,
    "requests": REQUESTS,
    "teacher_views": TEACHER_VIEWS,
}

# Fields the teacher patch feed may set (teacher_code is not patchable).
TEACHER_PATCHABLE = [
    "full_name", "email", "phone", "cv_link", "current_job_title", "subjects",
    "highest_qualification", "current_country", "current_region", "visa_status",
    "notice_period", "will_move_sem1", "will_move_sem2", "years_experience",
    "preferred_regions", "bio", "current_school_name", "profile_status",
    "is_visible_in_school_portal",
]

# School patch keys and the column each one writes (``description`` -> ``about``).
SCHOOL_PATCHABLE = {
    "name": "name", "contact_name": "contact_name", "email": "email", "website": "website",
    "country": "country", "region": "region", "description": "about", "phone": "phone",
    "city": "city", "address": "address",
}

"""Request reports: admin search (Q9) and the per-school feed with masking (Q10).

The request table is a fact; teachers and schools are dimensions joined by
key. Joins are left to AQE (runtime broadcast below the threshold, skew-split
sort-merge above it), so a school holding a third of all requests is split
across tasks instead of landing in one. Optional parameters only add
``filter``s; user text is never formatted into SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import like_contains
from chalkline.sources.schemas import REQUEST_STATUSES

# Fixed value: admin_notes shown to a school while no admin has answered.
NO_ADMIN_RESPONSE = "No response by admin still now"

# Teacher fields revealed to a school once the request is accepted.
REVEALED_FIELDS = [
    "full_name", "email", "phone", "cv_link", "current_job_title", "highest_qualification",
    "current_country", "current_region", "visa_status", "notice_period", "will_move_sem1",
    "will_move_sem2", "years_experience", "preferred_regions", "profile_status",
]


def _keep_ids(df: DataFrame, ids, col: str = "id") -> DataFrame:
    """Restrict to a set of keys given as a DataFrame (semi join) or a Python list."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(ids)))


def request_search(requests: DataFrame, teachers: DataFrame, schools: DataFrame,
                   status: str | None = None, search: str | None = None, ids=None,
                   teacher_id: int | None = None, school_id: int | None = None,
                   detail: bool = False) -> DataFrame:
    """Q9: requests with teacher and school labels, newest first.

    ``status`` None/''/'ALL' means no filter; an unknown status raises (the
    enum would reject it). ``search`` is a case-insensitive contains over
    school name, teacher code and school email. Left joins keep requests whose
    teacher or school is missing. ``detail`` gives the by-id column set (Q9b).
    """
    r = requests
    if status and status != "ALL":
        if status not in REQUEST_STATUSES:
            raise ValueError(f"invalid request status: {status!r}")
        r = r.filter(F.col("status") == status)
    if teacher_id is not None:
        r = r.filter(F.col("teacher_id") == teacher_id)
    if school_id is not None:
        r = r.filter(F.col("school_id") == school_id)
    r = _keep_ids(r, ids)
    t = teachers.select(F.col("id").alias("teacher_id"), "teacher_code",
                        F.col("full_name").alias("teacher_name"))
    s = schools.select(F.col("id").alias("school_id"), F.col("name").alias("school_name"),
                       F.col("email").alias("school_email"))
    j = r.join(t, "teacher_id", "left").join(s, "school_id", "left")
    if search:
        pat = like_contains(search)
        j = j.filter(F.col("school_name").ilike(pat) | F.col("teacher_code").ilike(pat)
                     | F.col("school_email").ilike(pat))
    if detail:
        cols = ["id", "teacher_id", "school_id", "status", "admin_notes", "requested_at",
                "teacher_code", "teacher_name", "school_name"]
    else:
        cols = ["id", "teacher_id", "school_id", "status", "admin_notes", "school_message",
                "requested_at", "teacher_code", "teacher_name", "school_name", "school_email"]
    return j.select(*cols).orderBy(F.desc("requested_at"), F.desc("id"))


def school_request_feed(requests: DataFrame, teachers: DataFrame, school_ids=None,
                        request_ids=None, detail: bool = False) -> DataFrame:
    """Q10: each school's requests with the teacher profile masked.

    The ``teacher`` struct is filled only for TEACHER_ACCEPTED requests and is
    null otherwise. The list form shows ``subjects`` outside the struct even
    when masked; the detail form (Q10b) moves it inside and drops school_id.
    All schools are served in one pass; ``school_ids``/``request_ids``
    restrict it. Inner join: requests of unknown teachers drop out.
    """
    r = _keep_ids(_keep_ids(requests, request_ids, "id"), school_ids, "school_id")
    t = teachers.select(F.col("id").alias("teacher_id"), "teacher_code", "subjects",
                        *REVEALED_FIELDS)
    j = r.join(t, "teacher_id")
    fields = list(REVEALED_FIELDS)
    if detail:
        fields.insert(fields.index("highest_qualification"), "subjects")
    teacher = F.when(F.col("status") == "TEACHER_ACCEPTED", F.struct(*fields))
    notes = F.coalesce(F.col("admin_notes"), F.lit(NO_ADMIN_RESPONSE)).alias("admin_notes")
    head = ["id", "teacher_id"] + ([] if detail else ["school_id"])
    tail = [] if detail else ["subjects"]
    return (j.select(*head, "teacher_code", "requested_at", "status", "school_message", notes,
                     *tail, teacher.alias("teacher"))
            .orderBy(F.desc("requested_at"), F.desc("id")))


def flatten_struct(df: DataFrame, col: str) -> DataFrame:
    """Replace a struct column by ``<col>_<field>`` columns (for flat exports)."""
    fields = df.schema[col].dataType.fieldNames()
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.col(f"{col}.{f}").alias(f"{col}_{f}") for f in fields])

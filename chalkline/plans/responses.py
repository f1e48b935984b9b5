"""Response shapes: rename query outputs to the field names API clients expect.

The library's columns are snake_case; dashboard and list clients read
camelCase keys (and ``teacherId`` carries the teacher *code*). These are pure
projections (``select`` + ``alias``), applied last, so they never change a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Response field name <- library column, per response.
RESPONSE_FIELDS = {
    "stats": {"totalViews": "views", "requests": "requests", "activeSchools": "active_schools",
              "conversion": "conversion"},
    "chartData": {"date": "name", "fullDate": "full_date", "views": "views", "requests": "requests"},
    "topSchools": {"name": "name", "location": "location", "views": "views"},
    "topTeachers": {"code": "code", "name": "name", "hits": "hits"},
    "regionData": {"name": "name", "value": "value", "color": "color"},
    "dashboardStats": {"activeTrials": "active_trials", "paidSubscriptions": "paid_subscriptions",
                       "totalSchools": "total_schools", "totalTeachers": "total_teachers",
                       "pendingRequests": "pending_requests"},
    "growth": {"name": "name", "teachers": "teachers", "schools": "schools"},
    "recentRequests": {"id": "id", "schoolName": "school_name", "teacherId": "teacher_code",
                       "time": "requested_at", "status": "status"},
    "requestList": {"id": "id", "schoolName": "school_name", "schoolEmail": "school_email",
                    "teacherId": "teacher_code", "teacherName": "teacher_name", "status": "status",
                    "requestedAt": "requested_at", "schoolMessage": "school_message", "adminNotes": "admin_notes"},
}

# Order columns that are not part of the response but fix the row order.
_ORDER = {"chartData": ["day"], "growth": ["month"], "topSchools": ["views", "school_id"],
          "topTeachers": ["hits", "teacher_id"], "regionData": ["rank"], "recentRequests": ["requested_at", "id"],
          "requestList": ["requested_at", "id"]}
_DESC = {"topSchools": [True, False], "topTeachers": [True, False], "recentRequests": [True, True],
         "requestList": [True, True]}


def to_response(df: DataFrame, kind: str) -> DataFrame:
    """Project ``df`` onto the response fields of ``kind`` in response order."""
    fields = RESPONSE_FIELDS[kind]
    order = _ORDER.get(kind, [])
    desc = _DESC.get(kind, [False] * len(order))
    keys = [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(order, desc)]
    out = df.orderBy(*keys) if keys else df
    return out.select(*[F.col(src).alias(dst) for dst, src in fields.items()])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition (no single-task coalesce)."""
    df.write.mode("overwrite").json(path)

"""DuckDB SQL oracle for the change-feed jobs (M1-M4, M7-M11) and the import (I1).

Feeds are rebuilt from the ``feed`` CTE (error events, slot = event_id % 10)
and from purchases, with the same formulas as ``chalkline.sources.fixtures``.
Patch feeds are written directly in their exploded (seq, id, field, value)
form, which is what the Spark job derives from the change maps.
"""

from __future__ import annotations

from chalkline.plans.oracle import AS_OF, with_base

SCHOOL_COLS = ["id", "name", "contact_name", "email", "website", "country", "region", "about", "phone",
               "city", "address", "subscription_status", "subscription_plan", "subscription_started_at",
               "subscription_end_at", "created_at", "updated_at", "verified"]
TEACHER_COLS = ["id", "teacher_code", "full_name", "email", "phone", "cv_link", "current_job_title", "subjects",
                "highest_qualification", "current_country", "current_region", "visa_status", "notice_period",
                "will_move_sem1", "will_move_sem2", "years_experience", "preferred_regions", "bio",
                "current_school_name", "profile_status", "is_visible_in_school_portal", "created_at", "updated_at"]
PROFILE_COLS = [c for c in TEACHER_COLS if c not in ("id", "bio", "current_school_name", "created_at", "updated_at")]


def _select(alias: str, cols: list[str], repl: dict[str, str]) -> str:
    return ",\n  ".join(f"{repl[c]} AS {c}" if c in repl else f"{alias}.{c}" for c in cols)


def _pivot(fields: list[str]) -> str:
    parts = []
    for f in fields:
        parts.append(f"max(CASE WHEN field = '{f}' THEN 1 END) AS s_{f}")
        parts.append(f"arg_max_null(value, seq) FILTER (WHERE field = '{f}') AS v_{f}")
    return ",\n    ".join(parts)


# ---- M1 -------------------------------------------------------------------------

EXPIRE_SUBSCRIPTIONS = with_base(f"""
SELECT * REPLACE (CASE WHEN subscription_end_at < {AS_OF} AND subscription_status <> 'EXPIRED'
                       THEN 'EXPIRED' ELSE subscription_status END AS subscription_status)
FROM schools
""")

# ---- M2 -------------------------------------------------------------------------

_DELETES = """
, dl AS (SELECT seq, ts, CASE WHEN n % 10 = 9 THEN k + 1000000 ELSE k END AS id FROM feed WHERE slot = 6)
, firsts AS (SELECT id, min(seq) AS seq, arg_min(ts, seq) AS ts FROM dl
             WHERE id IN (SELECT id FROM teachers) GROUP BY id)
"""

ARCHIVE_TEACHERS = with_base(_DELETES + f"""
SELECT f.seq + 1 AS archive_id, t.id AS original_teacher_id, {", ".join("t." + c for c in PROFILE_COLS)},
       t.created_at AS original_created_at, t.updated_at AS original_updated_at, f.ts AS archived_at
FROM teachers t JOIN firsts f ON t.id = f.id
""")

ARCHIVE_TEACHERS_REJECTS = with_base(_DELETES + """
SELECT d.seq, CAST(d.id AS VARCHAR) AS key, 'Teacher not found' AS reason
FROM dl d LEFT JOIN firsts f ON d.id = f.id
WHERE f.id IS NULL OR d.seq <> f.seq
""")

ARCHIVE_CASCADE_COUNTS = with_base(_DELETES + """
SELECT (SELECT count(*) FROM teachers WHERE id NOT IN (SELECT id FROM firsts)) AS teachers_left,
       (SELECT count(*) FROM requests WHERE teacher_id NOT IN (SELECT id FROM firsts)) AS requests_left,
       (SELECT count(*) FROM teacher_views WHERE teacher_id NOT IN (SELECT id FROM firsts)) AS views_left
""")

ARCHIVE_TEACHERS_LEFT = with_base(_DELETES + "SELECT * FROM teachers WHERE id NOT IN (SELECT id FROM firsts)")
ARCHIVE_REQUESTS_LEFT = with_base(_DELETES + "SELECT * FROM requests WHERE teacher_id NOT IN (SELECT id FROM firsts)")
ARCHIVE_VIEWS_LEFT = with_base(_DELETES + "SELECT * FROM teacher_views WHERE teacher_id NOT IN (SELECT id FROM firsts)")

# ---- M3 -------------------------------------------------------------------------

_TEACHER_PATCH_FIELDS = ["subjects", "bio", "profile_status", "is_visible_in_school_portal",
                         "years_experience", "current_region"]
_TEACHER_PATCHES = """
, tp AS (SELECT seq, ts, n, k, CASE WHEN n % 10 = 9 THEN k + 1000000 ELSE k END AS id FROM feed WHERE slot = 0)
, tp_cells AS (
  SELECT seq, id, ts, 'subjects' AS field, 'Subject ' || CAST(k % 13 AS VARCHAR) AS value FROM tp WHERE n % 4 = 0
  UNION ALL SELECT seq, id, ts, 'bio', NULL FROM tp WHERE n % 4 = 1
  UNION ALL SELECT seq, id, ts, 'profile_status', 'PLACED' FROM tp WHERE n % 4 = 2
  UNION ALL SELECT seq, id, ts, 'is_visible_in_school_portal', 'false' FROM tp WHERE n % 4 = 2
  UNION ALL SELECT seq, id, ts, 'years_experience', CAST(n % 40 AS VARCHAR) FROM tp WHERE n % 4 = 3
  UNION ALL SELECT seq, id, ts, 'current_region', 'Region ' || CAST(n % 7 AS VARCHAR) FROM tp WHERE n % 4 = 3
  UNION ALL SELECT seq, id, ts, 'subjects', NULL FROM tp WHERE n % 4 = 3
)
"""


def _teacher_value(f: str) -> str:
    v = f"l.v_{f}"
    if f == "years_experience":
        v = f"TRY_CAST(l.v_{f} AS INTEGER)"
    elif f == "is_visible_in_school_portal":
        v = f"TRY_CAST(lower(trim(l.v_{f})) AS BOOLEAN)"
    return f"CASE WHEN l.s_{f} = 1 THEN {v} ELSE t.{f} END"


_tp_repl = {f: _teacher_value(f) for f in _TEACHER_PATCH_FIELDS}
_tp_repl["updated_at"] = "COALESCE(tt.ts, t.updated_at)"

_TEACHER_BAD = """
, tp_bad AS (
  SELECT DISTINCT seq FROM tp_cells
  WHERE (field IN ('full_name', 'email', 'will_move_sem1', 'will_move_sem2', 'profile_status',
                   'is_visible_in_school_portal') AND value IS NULL)
     OR (field = 'profile_status' AND value NOT IN ('ACTIVE', 'INACTIVE', 'PLACED'))
     OR (field = 'years_experience' AND value IS NOT NULL AND TRY_CAST(value AS INTEGER) IS NULL)
     OR (field IN ('will_move_sem1', 'will_move_sem2', 'is_visible_in_school_portal') AND value IS NOT NULL
         AND TRY_CAST(lower(trim(value)) AS BOOLEAN) IS NULL))
, tp_ok AS (SELECT * FROM tp WHERE id IN (SELECT id FROM teachers) AND seq NOT IN (SELECT seq FROM tp_bad))
"""

APPLY_TEACHER_PATCHES = with_base(_TEACHER_PATCHES + _TEACHER_BAD + f"""
, last AS (SELECT id, {_pivot(_TEACHER_PATCH_FIELDS)} FROM tp_cells
           WHERE seq IN (SELECT seq FROM tp_ok) GROUP BY id)
, touched AS (SELECT id, arg_max(ts, seq) AS ts FROM tp_ok GROUP BY id)
SELECT {_select("t", TEACHER_COLS, _tp_repl)}
FROM teachers t LEFT JOIN last l ON t.id = l.id LEFT JOIN touched tt ON t.id = tt.id
""")

APPLY_TEACHER_PATCHES_REJECTS = with_base(_TEACHER_PATCHES + _TEACHER_BAD + """
SELECT seq, CAST(id AS VARCHAR) AS key, 'Teacher not found' AS reason FROM tp
WHERE id NOT IN (SELECT id FROM teachers)
UNION ALL
SELECT seq, CAST(id AS VARCHAR) AS key, 'Invalid value for a column' AS reason FROM tp
WHERE id IN (SELECT id FROM teachers) AND seq IN (SELECT seq FROM tp_bad)
""")

# ---- M4 -------------------------------------------------------------------------

_SCHOOL_PATCH_KEYS = {"description": "about", "city": "city", "email": "email", "name": "name",
                      "phone": "phone", "region": "region"}
_SCHOOL_PATCHES = """
, sp AS (SELECT seq, ts, n, k, CASE WHEN n % 10 = 9 THEN user_id + 1000000 ELSE user_id END AS id
         FROM feed WHERE slot = 1)
, sp_cells AS (
  SELECT seq, id, ts, 'description' AS field, 'About ' || CAST(n AS VARCHAR) AS value FROM sp WHERE n % 5 = 0
  UNION ALL SELECT seq, id, ts, 'city', 'City ' || CAST(k % 9 AS VARCHAR) FROM sp WHERE n % 5 = 0
  UNION ALL SELECT seq, id, ts, 'email', 'shared' || CAST(n // 25 AS VARCHAR) || '@example.org' FROM sp WHERE n % 5 = 1
  UNION ALL SELECT seq, id, ts, 'email', 'customer#' || lpad(CAST(k AS VARCHAR), CAST(greatest(9, len(CAST(k AS VARCHAR))) AS INTEGER), '0') || '@example.org'
            FROM sp WHERE n % 5 = 3
  UNION ALL SELECT seq, id, ts, 'name', 'Renamed ' || CAST(n AS VARCHAR) FROM sp WHERE n % 5 = 3
  UNION ALL SELECT seq, id, ts, 'phone', NULL FROM sp WHERE n % 5 = 4
  UNION ALL SELECT seq, id, ts, 'region', 'Region ' || CAST(k % 3 AS VARCHAR) FROM sp WHERE n % 5 = 4
)
, sp_head AS (
  SELECT p.seq, p.id, p.ts,
         (SELECT count(*) FROM sp_cells c WHERE c.seq = p.seq) AS nkeys,
         (SELECT max(value) FROM sp_cells c WHERE c.seq = p.seq AND c.field = 'email') AS email,
         EXISTS (SELECT 1 FROM sp_cells c WHERE c.seq = p.seq AND c.field = 'email') AS has_email,
         p.id IN (SELECT id FROM schools) AS known,
         EXISTS (SELECT 1 FROM sp_cells c WHERE c.seq = p.seq AND c.field IN ('name', 'contact_name', 'email')
                 AND c.value IS NULL) AS bad
  FROM sp p)
, sp_taken AS (
  SELECT h.*, h.has_email AND EXISTS (SELECT 1 FROM schools s WHERE s.email = h.email AND s.id <> h.id) AS taken
  FROM sp_head h)
, claims AS (
  SELECT email, arg_min(id, seq) AS claimer FROM sp_taken
  WHERE known AND nkeys > 0 AND NOT taken AND NOT bad AND has_email AND email IS NOT NULL GROUP BY email)
, judged AS (
  SELECT t.*, CASE WHEN NOT t.known THEN 'School not found'
                   WHEN t.nkeys = 0 THEN 'No valid fields provided'
                   WHEN t.taken OR (t.has_email AND c.claimer IS NOT NULL AND c.claimer <> t.id)
                     THEN 'Email already in use'
                   WHEN t.bad THEN 'Invalid value for a column' END AS reason
  FROM sp_taken t LEFT JOIN claims c ON t.email = c.email)
"""

_sp_repl = {col: f"CASE WHEN l.s_{key} = 1 THEN l.v_{key} ELSE s.{col} END" for key, col in _SCHOOL_PATCH_KEYS.items()}
_sp_repl["updated_at"] = "COALESCE(tt.ts, s.updated_at)"

APPLY_SCHOOL_PATCHES = with_base(_SCHOOL_PATCHES + f"""
, ok_cells AS (SELECT c.* FROM sp_cells c JOIN judged j ON c.seq = j.seq WHERE j.reason IS NULL)
, last AS (SELECT id, {_pivot(list(_SCHOOL_PATCH_KEYS))} FROM ok_cells GROUP BY id)
, touched AS (SELECT id, arg_max(ts, seq) AS ts FROM judged WHERE reason IS NULL GROUP BY id)
SELECT {_select("s", SCHOOL_COLS, _sp_repl)}
FROM schools s LEFT JOIN last l ON s.id = l.id LEFT JOIN touched tt ON s.id = tt.id
""")

APPLY_SCHOOL_PATCHES_REJECTS = with_base(_SCHOOL_PATCHES + """
SELECT seq, CAST(id AS VARCHAR) AS key, reason FROM judged WHERE reason IS NOT NULL
""")

# ---- M7 -------------------------------------------------------------------------

_CHECKOUTS = """
, co AS (
  SELECT seq, ts, 'cs_' || CAST(n // 8 AS VARCHAR) AS session_id, user_id AS school_id,
         CASE WHEN k % 9 = 0 THEN 'wrong@example.org'
              ELSE 'customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, len(CAST(user_id AS VARCHAR))) AS INTEGER), '0') || '@example.org' END AS email,
         CASE k % 4 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'PRO' WHEN 2 THEN 'ULTIMATE' ELSE 'GOLD' END AS plan,
         CASE WHEN k % 5 = 0 THEN 'unpaid' ELSE 'paid' END AS payment_status
  FROM feed WHERE slot = 3)
, payable AS (
  SELECT c.*, CASE
      WHEN COALESCE(c.payment_status, '') <> 'paid' THEN 'Payment not completed yet'
      WHEN c.plan IS NULL OR c.plan NOT IN ('BASIC', 'PRO', 'ULTIMATE') THEN 'Invalid plan'
      WHEN NOT EXISTS (SELECT 1 FROM schools s WHERE s.id = c.school_id AND s.email = c.email)
        THEN 'School not found or update failed' END AS refused
  FROM co c)
, judged AS (
  SELECT *, CASE WHEN refused IS NOT NULL THEN refused
                 WHEN row_number() OVER (PARTITION BY session_id, refused ORDER BY seq) > 1
                   THEN 'Duplicate checkout session' END AS reason
  FROM payable)
"""

ACTIVATE_PAID_PLANS = with_base(_CHECKOUTS + f"""
, ok AS (
  SELECT *, CAST(date_trunc('month', ts) AS TIMESTAMP)
              + to_months(CASE plan WHEN 'BASIC' THEN 1 WHEN 'PRO' THEN 6 ELSE 12 END)
              + (ts - CAST(date_trunc('month', ts) AS TIMESTAMP)) AS end_at
  FROM judged WHERE reason IS NULL)
, last AS (SELECT school_id, arg_max(plan, seq) AS plan, arg_max(ts, seq) AS ts, arg_max(end_at, seq) AS end_at
           FROM ok GROUP BY school_id)
SELECT {_select("s", SCHOOL_COLS, {
    "subscription_status": "CASE WHEN l.ts IS NOT NULL THEN 'ACTIVE' ELSE s.subscription_status END",
    "subscription_plan": "CASE WHEN l.ts IS NOT NULL THEN l.plan ELSE s.subscription_plan END",
    "subscription_started_at": "CASE WHEN l.ts IS NOT NULL THEN l.ts ELSE s.subscription_started_at END",
    "subscription_end_at": "CASE WHEN l.ts IS NOT NULL THEN l.end_at ELSE s.subscription_end_at END"})}
FROM schools s LEFT JOIN last l ON s.id = l.school_id
""")

ACTIVATE_PAID_PLANS_REJECTS = with_base(_CHECKOUTS + """
SELECT seq, CAST(school_id AS VARCHAR) AS key, reason FROM judged WHERE reason IS NOT NULL
""")

# ---- M8 -------------------------------------------------------------------------

_OVERRIDES = """
, ov AS (
  SELECT seq, ts, CASE WHEN n % 10 = 9 THEN user_id + 1000000 ELSE user_id END AS school_id,
         CASE k % 5 WHEN 0 THEN 'TRIAL' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'EXPIRED' WHEN 3 THEN 'BOGUS' END AS status,
         CAST(k % 50 - 5 AS INTEGER) AS hours
  FROM feed WHERE slot = 4)
, judged AS (
  SELECT o.*, CASE WHEN status IS NULL OR status = '' THEN 'subscription_status is required'
                   WHEN status NOT IN ('TRIAL', 'ACTIVE', 'EXPIRED') THEN 'Invalid subscription_status value'
                   WHEN hours IS NULL OR hours = 0 THEN 'subscription_expires_at (hours) is required'
                   WHEN hours < 0 THEN 'subscription_expires_at must be a positive number of hours'
                   WHEN school_id NOT IN (SELECT id FROM schools) THEN 'School not found' END AS reason
  FROM ov o)
"""

OVERRIDE_SUBSCRIPTION = with_base(_OVERRIDES + f"""
, last AS (SELECT school_id, arg_max(status, seq) AS st, arg_max(hours, seq) AS h, arg_max(ts, seq) AS ts
           FROM judged WHERE reason IS NULL GROUP BY school_id)
SELECT {_select("s", SCHOOL_COLS, {
    "subscription_status": "CASE WHEN l.ts IS NOT NULL THEN l.st ELSE s.subscription_status END",
    "subscription_started_at": "CASE WHEN l.ts IS NOT NULL THEN l.ts ELSE s.subscription_started_at END",
    "subscription_end_at": "CASE WHEN l.ts IS NOT NULL THEN l.ts + to_hours(l.h) ELSE s.subscription_end_at END",
    "updated_at": "CASE WHEN l.ts IS NOT NULL THEN l.ts ELSE s.updated_at END"})}
FROM schools s LEFT JOIN last l ON s.id = l.school_id
""")

OVERRIDE_SUBSCRIPTION_REJECTS = with_base(_OVERRIDES + """
SELECT seq, CAST(school_id AS VARCHAR) AS key, reason FROM judged WHERE reason IS NOT NULL
""")

# ---- M9 -------------------------------------------------------------------------

_CANCELS = """
, cx AS (SELECT seq, ts, CASE WHEN n % 10 = 9 THEN user_id + 1000000 ELSE user_id END AS id FROM feed WHERE slot = 7)
, last AS (SELECT id, arg_max(ts, seq) AS ts FROM cx WHERE id IN (SELECT id FROM schools) GROUP BY id)
"""

CANCEL_SUBSCRIPTIONS = with_base(_CANCELS + f"""
SELECT {_select("s", SCHOOL_COLS, {
    "subscription_status": "CASE WHEN l.ts IS NOT NULL THEN 'NO_SUBSCRIPTION' ELSE s.subscription_status END",
    "subscription_plan": "CASE WHEN l.ts IS NOT NULL THEN NULL ELSE s.subscription_plan END",
    "subscription_end_at": "CASE WHEN l.ts IS NOT NULL THEN l.ts ELSE s.subscription_end_at END"})}
FROM schools s LEFT JOIN last l ON s.id = l.id
""")

CANCEL_SUBSCRIPTIONS_CODES = with_base(_CANCELS + """
SELECT * REPLACE (CASE WHEN school_id IN (SELECT id FROM last) THEN 'EXPIRED' ELSE status END AS status)
FROM access_codes
""")

CANCEL_SUBSCRIPTIONS_REJECTS = with_base(_CANCELS + """
SELECT seq, CAST(id AS VARCHAR) AS key, 'School not found' AS reason FROM cx WHERE id NOT IN (SELECT id FROM schools)
""")

# ---- M10 ------------------------------------------------------------------------

_REQUEST_EVENTS = """
, pe AS (SELECT * FROM ev WHERE event_type = 'purchase')
, rev AS (
  SELECT event_id * 4 AS seq, 'create' AS kind, event_id - 10 * CAST(n % 4 = 1 AS BIGINT) AS request_id,
         CASE WHEN n % 17 = 0 THEN -k ELSE k END AS teacher_id, CASE WHEN n % 19 = 0 THEN -user_id ELSE user_id END AS school_id,
         CAST(NULL AS VARCHAR) AS status,
         CASE n % 3 WHEN 1 THEN '' WHEN 2 THEN 'Hello ' || CAST(n AS VARCHAR) END AS message,
         CAST(NULL AS VARCHAR) AS admin_notes, ts
  FROM feed WHERE slot = 5
  UNION ALL
  SELECT event_id * 4 + 1, 'set_status', event_id, NULL, NULL,
         CASE (event_id // 7) % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'TEACHER_CONTACTED' WHEN 2 THEN 'TEACHER_ACCEPTED'
              WHEN 3 THEN 'TEACHER_DECLINED' WHEN 4 THEN 'CLOSED' END,
         NULL, CASE WHEN event_id % 2 = 1 THEN 'Reviewed ' || CAST(event_id AS VARCHAR) END, ts
  FROM pe WHERE event_id % 7 = 0
  UNION ALL
  SELECT event_id * 4 + 3, 'set_status', event_id + 1, NULL, NULL, 'CLOSED', NULL, NULL, ts
  FROM pe WHERE event_id % 13 = 0
  UNION ALL
  SELECT event_id * 4 + 2, 'close', event_id, k, CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id + 1 END,
         NULL, NULL, NULL, ts
  FROM pe WHERE event_id % 11 = 0)
, made AS (
  SELECT *, CASE WHEN teacher_id NOT IN (SELECT id FROM teachers) THEN 'Teacher not found'
                 WHEN school_id NOT IN (SELECT id FROM schools) THEN 'School not found'
                 WHEN request_id IN (SELECT id FROM requests) THEN 'Duplicate request id' END AS refused
  FROM rev WHERE kind = 'create')
, created AS (
  SELECT * EXCLUDE (refused), CASE WHEN refused IS NOT NULL THEN refused
         WHEN row_number() OVER (PARTITION BY request_id, refused ORDER BY seq) > 1 THEN 'Duplicate request id' END AS reason
  FROM made)
, base AS (
  SELECT id, teacher_id, school_id, requested_at, status, school_message, admin_notes FROM requests
  UNION ALL
  SELECT request_id, teacher_id, school_id, ts, 'PENDING',
         CASE WHEN COALESCE(message, '') = '' THEN 'Interested in this teacher and would like to connect.'
              ELSE message END, NULL
  FROM created WHERE reason IS NULL)
, judged AS (
  SELECT e.*, CASE
      WHEN b.id IS NULL THEN CASE WHEN e.kind = 'close' THEN 'Request not found or not authorized'
                                  ELSE 'Request not found' END
      WHEN e.kind = 'close' AND NOT COALESCE(e.teacher_id = b.teacher_id AND e.school_id = b.school_id, FALSE)
        THEN 'Request not found or not authorized'
      WHEN e.kind = 'set_status' AND e.status IS NULL THEN 'status is required'
      WHEN e.kind = 'set_status' AND e.status NOT IN ('PENDING', 'TEACHER_CONTACTED', 'TEACHER_ACCEPTED',
                                                     'TEACHER_DECLINED', 'CLOSED') THEN 'Invalid request status'
      END AS reason
  FROM rev e LEFT JOIN (
      SELECT id, teacher_id, school_id, -1 AS born FROM requests
      UNION ALL
      SELECT request_id, teacher_id, school_id, seq FROM created WHERE reason IS NULL
    ) b ON e.request_id = b.id AND b.born < e.seq
  WHERE e.kind <> 'create')
"""

APPLY_REQUEST_EVENTS = with_base(_REQUEST_EVENTS + """
, folded AS (
  SELECT request_id AS id,
         arg_max(CASE WHEN kind = 'close' THEN 'CLOSED' ELSE status END, seq) AS st,
         arg_max_null(COALESCE(admin_notes, ''), seq) FILTER (WHERE kind = 'set_status') AS nt,
         max(CASE WHEN kind = 'set_status' THEN 1 END) AS has_set
  FROM judged WHERE reason IS NULL GROUP BY request_id)
SELECT b.id, b.teacher_id, b.school_id, b.requested_at, COALESCE(f.st, b.status) AS status, b.school_message,
       CASE WHEN f.has_set = 1 THEN f.nt ELSE b.admin_notes END AS admin_notes
FROM base b LEFT JOIN folded f ON b.id = f.id
""")

APPLY_REQUEST_EVENTS_REJECTS = with_base(_REQUEST_EVENTS + """
SELECT seq, CAST(request_id AS VARCHAR) AS key, reason FROM judged WHERE reason IS NOT NULL
UNION ALL
SELECT seq, CAST(request_id AS VARCHAR), reason FROM created WHERE reason IS NOT NULL
""")

# ---- M11 ------------------------------------------------------------------------

_CODE_OPS = """
, ops AS (
  SELECT seq, ts, CASE WHEN n % 4 = 3 THEN 'expire' ELSE 'create' END AS op,
         CASE n % 4 WHEN 0 THEN 'N' || CAST(n // 8 AS VARCHAR) WHEN 1 THEN 'C' || CAST(k * 20 AS VARCHAR)
                    WHEN 2 THEN '' END AS code,
         CASE WHEN n % 4 = 3 THEN 'C' || CAST(event_id - 3 AS VARCHAR) END AS id
  FROM feed WHERE slot = 8)
, cr AS (
  SELECT o.*, CASE WHEN o.code IS NULL OR o.code = '' THEN 'Access code is required'
                   WHEN o.code IN (SELECT code FROM access_codes)
                     OR o.seq <> (SELECT min(seq) FROM ops o2 WHERE o2.op = 'create' AND o2.code = o.code)
                     THEN 'Access code already exists' END AS reason
  FROM ops o WHERE o.op = 'create')
, new_rows AS (
  SELECT code AS id, code, CAST(NULL AS BIGINT) AS school_id, 'UNUSED' AS status, ts AS created_at,
         CAST(NULL AS TIMESTAMP) AS first_used_at, CAST(NULL AS TIMESTAMP) AS expires_at, seq AS made
  FROM cr WHERE reason IS NULL)
, ex AS (
  SELECT o.*, CASE WHEN o.id NOT IN (SELECT id FROM access_codes)
                    AND NOT EXISTS (SELECT 1 FROM new_rows nr WHERE nr.id = o.id AND nr.made < o.seq)
                   THEN 'Access code not found' END AS reason
  FROM ops o WHERE o.op = 'expire')
"""

MAINTAIN_ACCESS_CODES = with_base(_CODE_OPS + """
, base AS (SELECT id, code, school_id, status, created_at, first_used_at, expires_at FROM access_codes
           UNION ALL
           SELECT id, code, school_id, status, created_at, first_used_at, expires_at FROM new_rows)
SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM ex WHERE reason IS NULL) THEN 'EXPIRED' ELSE status END AS status)
FROM base
""")

MAINTAIN_ACCESS_CODES_REJECTS = with_base(_CODE_OPS + """
SELECT seq, code AS key, reason FROM cr WHERE reason IS NOT NULL
UNION ALL
SELECT seq, id AS key, reason FROM ex WHERE reason IS NOT NULL
""")

# ---- I1 -------------------------------------------------------------------------

_SHEET = r"""
, sheet AS (
  SELECT CAST(p_partkey + 2 AS INTEGER) AS sheet_row,
         CASE WHEN p_partkey % 13 = 0 THEN NULL
              WHEN p_partkey % 17 = 0 THEN 'T-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, len(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')
              ELSE 'I-' || CAST(p_partkey // 2 AS VARCHAR) END AS code,
         CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS full_name,
         'i' || CAST(p_partkey AS VARCHAR) || '@example.org' AS email,
         p_brand AS job_title, p_name AS subjects, p_type AS qual,
         'Country ' || CAST(p_size % 5 AS VARCHAR) AS country, 'Bio ' || CAST(p_partkey AS VARCHAR) AS bio,
         CASE p_partkey % 6 WHEN 0 THEN 'YES ' WHEN 1 THEN 'no' WHEN 3 THEN 'true' WHEN 4 THEN '1'
                            WHEN 5 THEN 'False' END AS wm1,
         CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '' END AS wm2,
         CASE p_size % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 3 THEN '1' END AS vis,
         CASE p_partkey % 6 WHEN 0 THEN '12abc' WHEN 1 THEN '' WHEN 2 THEN '-3.9' WHEN 3 THEN ' 7'
                            WHEN 4 THEN 'x' END AS years,
         CASE p_partkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN '' WHEN 3 THEN ' Placed ' WHEN 4 THEN 'bogus' END AS pstatus
  FROM part)
, parsed AS (
  SELECT s.*, CASE WHEN pstatus IS NULL OR pstatus = '' THEN 'ACTIVE' ELSE upper(trim(pstatus)) END AS st,
         (code IS NULL OR code = '' OR full_name IS NULL OR full_name = '' OR email IS NULL OR email = '') AS missing,
         COALESCE(code IN (SELECT teacher_code FROM teachers), FALSE) AS exists_
  FROM sheet s)
, firsts AS (
  SELECT code, min(sheet_row) AS first_row FROM parsed
  WHERE NOT missing AND st IN ('ACTIVE', 'INACTIVE', 'PLACED') AND NOT exists_ GROUP BY code)
, judged AS (
  SELECT p.*, CASE
      WHEN missing THEN 'Row ' || CAST(sheet_row AS VARCHAR) || ': Missing Code, Name, or Email'
      WHEN st NOT IN ('ACTIVE', 'INACTIVE', 'PLACED') THEN 'Row ' || CAST(sheet_row AS VARCHAR) || ' (' || p.code
           || '): invalid input value for enum teacher_profile_status: "' || st || '"'
      WHEN exists_ OR sheet_row <> f.first_row
        THEN 'Row ' || CAST(sheet_row AS VARCHAR) || ': Skipped (Duplicate Teacher Code: ' || p.code || ')' END AS reason
  FROM parsed p LEFT JOIN firsts f ON p.code = f.code)
"""

TEACHER_IMPORT = with_base(_SHEET + rf"""
SELECT CAST((SELECT max(id) FROM teachers) + sheet_row AS BIGINT) AS id, code AS teacher_code, full_name, email,
       '' AS phone, '' AS cv_link, COALESCE(job_title, '') AS current_job_title, COALESCE(subjects, '') AS subjects,
       COALESCE(qual, '') AS highest_qualification, COALESCE(country, '') AS current_country,
       '' AS current_region, '' AS visa_status, '' AS notice_period,
       COALESCE(lower(trim(wm1)) IN ('yes', 'true', '1'), FALSE) AS will_move_sem1,
       COALESCE(lower(trim(wm2)) IN ('yes', 'true', '1'), FALSE) AS will_move_sem2,
       COALESCE(TRY_CAST(NULLIF(regexp_extract(years, '^\s*([+-]?\d+)', 1), '') AS INTEGER), 0) AS years_experience,
       '' AS preferred_regions, COALESCE(bio, '') AS bio, '' AS current_school_name,
       st AS profile_status,
       COALESCE(lower(trim(vis)) IN ('yes', 'true', '1'), FALSE) AS is_visible_in_school_portal,
       {AS_OF} AS created_at, {AS_OF} AS updated_at
FROM judged WHERE reason IS NULL
""")

TEACHER_IMPORT_REJECTS = with_base(_SHEET + """
SELECT sheet_row, code AS teacher_code, reason FROM judged WHERE reason IS NOT NULL
""")

TEACHER_IMPORT_SUMMARY = with_base(_SHEET + """
SELECT count(*) AS total_rows_found, count(*) FILTER (WHERE reason IS NULL) AS successfully_inserted,
       count(*) FILTER (WHERE reason IS NOT NULL) AS errors
FROM judged
""")

# The same sheet read from files, whose bios hold quotes and a line end.
TEACHER_IMPORT_FILES = TEACHER_IMPORT.replace("COALESCE(bio, '') AS bio", """'"Bio"' || chr(10) || substr(bio, 5) AS bio""")
TEACHER_IMPORT_FILES_REJECTS = TEACHER_IMPORT_REJECTS.replace("SELECT sheet_row,", "SELECT CAST(sheet_row AS BIGINT) AS sheet_row,")


# ---- M5, M6: sequential walks (independent of the Spark matching rounds) -------------------
# A recursive CTE visits the attempts one by one in seq order, carrying the
# schools (or addresses) and codes consumed by earlier successes.

_REDEEM_WALK = """
, att AS (
  SELECT row_number() OVER (ORDER BY a.seq) AS rn, a.seq, a.school_id, a.code, a.ts,
         s.id IS NOT NULL AS known,
         COALESCE(s.subscription_status = 'NO_SUBSCRIPTION' AND s.subscription_plan IS NULL
                  AND s.subscription_end_at IS NULL, FALSE) AS eligible,
         EXISTS (SELECT 1 FROM access_codes c WHERE c.code = a.code) AS code_exists,
         EXISTS (SELECT 1 FROM access_codes c WHERE c.school_id = a.school_id) AS holds,
         EXISTS (SELECT 1 FROM access_codes c WHERE c.code = a.code AND c.status = 'UNUSED') AS unused
  FROM redeem_attempts a LEFT JOIN schools s ON s.id = a.school_id)
, walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS us, CAST([] AS VARCHAR[]) AS uc,
         CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT x.rn, CASE WHEN x.reason IS NULL THEN list_append(x.us, x.school_id) ELSE x.us END,
         CASE WHEN x.reason IS NULL THEN list_append(x.uc, x.code) ELSE x.uc END, x.reason
  FROM (SELECT a.rn, a.school_id, a.code, w.us, w.uc,
               CASE WHEN a.code IS NULL OR a.code = '' THEN 'Access code is required'
                    WHEN NOT a.known THEN 'School not found'
                    WHEN NOT a.eligible OR list_contains(w.us, a.school_id) THEN 'You already use paid subscription'
                    WHEN NOT a.code_exists THEN 'Invalid access code'
                    WHEN a.holds THEN 'You already used your trial access.'
                    WHEN NOT a.unused OR list_contains(w.uc, a.code)
                      THEN 'Code is already used. Please try a different code.' END AS reason
        FROM walk w JOIN att a ON a.rn = w.rn + 1) x)
, outcome AS (SELECT a.seq, a.school_id, a.code, a.ts, w.reason FROM walk w JOIN att a ON a.rn = w.rn)
"""

REDEEM_ACCESS_CODES = with_base(_REDEEM_WALK + """
SELECT seq, school_id, code, ts, reason IS NULL AS accepted, reason FROM outcome
""", recursive=True)

REDEEM_ACCESS_CODES_SCHOOLS = with_base(_REDEEM_WALK + f"""
, ok AS (SELECT school_id, ts FROM outcome WHERE reason IS NULL)
SELECT {_select("s", SCHOOL_COLS, {
    "subscription_status": "CASE WHEN ok.ts IS NOT NULL THEN 'TRIAL' ELSE s.subscription_status END",
    "subscription_started_at": "CASE WHEN ok.ts IS NOT NULL THEN ok.ts ELSE s.subscription_started_at END",
    "subscription_end_at": "CASE WHEN ok.ts IS NOT NULL THEN ok.ts + INTERVAL 24 HOUR ELSE s.subscription_end_at END"})}
FROM schools s LEFT JOIN ok ON s.id = ok.school_id
""", recursive=True)

def _used_codes(winners: str) -> str:
    """The code table after ``winners`` (code, school, ts) used theirs."""
    return f"""
, ok AS ({winners})
SELECT c.* REPLACE (CASE WHEN ok.ts IS NULL THEN c.status ELSE 'ACTIVE' END AS status,
                    COALESCE(ok.school, c.school_id) AS school_id, COALESCE(ok.ts, c.first_used_at) AS first_used_at,
                    COALESCE(ok.ts + INTERVAL 24 HOUR, c.expires_at) AS expires_at)
FROM access_codes c LEFT JOIN ok ON c.code = ok.code
"""


REDEEM_ACCESS_CODES_CODES = with_base(_REDEEM_WALK + _used_codes(
    "SELECT code, school_id AS school, ts FROM outcome WHERE reason IS NULL"), recursive=True)

_SIGNUP_WALK = r"""
, su AS (
  SELECT seq, ts,
         CASE WHEN n % 6 = 0 THEN '' ELSE 'New School ' || CAST(n AS VARCHAR) END AS name,
         CASE WHEN n % 5 <> 0 THEN 'Contact ' || CAST(n AS VARCHAR) END AS contact_name,
         CASE WHEN n % 7 = 0 THEN 'not-an-email'
              WHEN n % 7 = 1 THEN 'Customer#' || lpad(CAST(k AS VARCHAR), CAST(greatest(9, len(CAST(k AS VARCHAR))) AS INTEGER), '0') || '@Example.org'
              ELSE 'New' || CAST(n // 4 AS VARCHAR) || '@Example.org' END AS email,
         'Country ' || CAST(k % 4 AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS region,
         CASE WHEN n % 3 = 0 THEN 'C' || CAST(n * 7 AS VARCHAR) END AS access_code
  FROM feed WHERE slot = 2)
, sj AS (
  SELECT row_number() OVER (ORDER BY seq) AS rn, su.*, lower(trim(email)) AS nemail,
         COALESCE(name IS NOT NULL AND length(name) BETWEEN 1 AND 200 AND email IS NOT NULL
                  AND regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$'), FALSE) AS valid,
         COALESCE(lower(trim(email)) IN (SELECT lower(trim(email)) FROM schools), FALSE) AS exists_,
         (access_code IS NOT NULL AND access_code <> '') AS has_code,
         COALESCE(access_code IN (SELECT code FROM access_codes WHERE status = 'UNUSED'), FALSE) AS unused
  FROM su)
, walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS ue, CAST([] AS VARCHAR[]) AS uc,
         CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT x.rn, CASE WHEN x.reason IS NULL THEN list_append(x.ue, x.nemail) ELSE x.ue END,
         CASE WHEN x.reason IS NULL AND x.has_code THEN list_append(x.uc, x.access_code) ELSE x.uc END, x.reason
  FROM (SELECT a.rn, a.nemail, a.access_code, a.has_code, w.ue, w.uc,
               CASE WHEN NOT a.valid THEN 'Invalid input'
                    WHEN a.contact_name IS NULL THEN 'contact_name is required'
                    WHEN a.exists_ OR list_contains(w.ue, a.nemail) THEN 'School with this email already exists'
                    WHEN a.has_code AND (NOT a.unused OR list_contains(w.uc, a.access_code))
                      THEN 'Invalid or used access code.' END AS reason
        FROM walk w JOIN sj a ON a.rn = w.rn + 1) x)
, outcome AS (SELECT a.*, w.reason FROM walk w JOIN sj a ON a.rn = w.rn)
"""

REGISTER_SCHOOLS = with_base(_SIGNUP_WALK + """
SELECT CAST((SELECT max(id) FROM schools) + 1 + seq AS BIGINT) AS id, name, contact_name, nemail AS email,
       CAST(NULL AS VARCHAR) AS website, country, region, CAST(NULL AS VARCHAR) AS about,
       CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS address,
       CASE WHEN has_code THEN 'TRIAL' ELSE 'NO_SUBSCRIPTION' END AS subscription_status,
       CAST(NULL AS VARCHAR) AS subscription_plan,
       CASE WHEN has_code THEN ts END AS subscription_started_at,
       CASE WHEN has_code THEN ts + INTERVAL 24 HOUR END AS subscription_end_at,
       ts AS created_at, ts AS updated_at, FALSE AS verified
FROM outcome WHERE reason IS NULL
""", recursive=True)

REGISTER_SCHOOLS_REJECTS = with_base(_SIGNUP_WALK + """
SELECT seq, nemail AS key, reason FROM outcome WHERE reason IS NOT NULL
""", recursive=True)

REGISTER_SCHOOLS_CODES = with_base(_SIGNUP_WALK + _used_codes(
    "SELECT access_code AS code, CAST((SELECT max(id) FROM schools) + 1 + seq AS BIGINT) AS school, ts "
    "FROM outcome WHERE reason IS NULL AND has_code"), recursive=True)

# Q11c on the patched teachers, the only ones with a region.
PORTAL_TEACHER_REGION = f"""
SELECT id, teacher_code, highest_qualification, years_experience, current_country, visa_status, profile_status, bio
FROM ({APPLY_TEACHER_PATCHES}) patched WHERE is_visible_in_school_portal AND current_region = 'Region 3'
"""

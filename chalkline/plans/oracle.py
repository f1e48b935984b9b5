"""DuckDB SQL oracle for every registered query.

The driver pre-registers the generated tables as views. The ``BASE`` CTEs
rebuild the domain tables with the same formulas as
``chalkline.sources.fixtures`` (written independently in SQL), and each
query below is the plain-SQL statement of what the Spark job computes.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

BASE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
),
seg AS (
  SELECT c.*, n.n_name, r.r_name,
         CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'ACTIVE'
              WHEN c.c_mktsegment = 'BUILDING' THEN 'TRIAL'
              WHEN c.c_mktsegment = 'FURNITURE' THEN 'EXPIRED'
              ELSE 'NO_SUBSCRIPTION' END AS st,
         CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING', 'FURNITURE')
              THEN {AS_OF} + to_days(CAST(c.c_custkey % 61 - 30 AS INTEGER)) END AS end_at
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
schools AS (
  SELECT c_custkey AS id, c_name AS name, 'Contact ' || CAST(c_custkey AS VARCHAR) AS contact_name,
         lower(c_name) || '@example.org' AS email, CAST(NULL AS VARCHAR) AS website,
         CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS country,
         CASE WHEN c_custkey % 5 <> 0 THEN r_name END AS region,
         CAST(NULL AS VARCHAR) AS about, CAST(NULL AS VARCHAR) AS phone,
         CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS address,
         st AS subscription_status,
         CASE WHEN st = 'ACTIVE' THEN CASE c_custkey % 3 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'PRO' ELSE 'ULTIMATE' END END
           AS subscription_plan,
         end_at - INTERVAL 30 DAY AS subscription_started_at,
         end_at AS subscription_end_at,
         {AS_OF} - to_days(CAST(c_custkey % 300 AS INTEGER)) AS created_at,
         {AS_OF} - to_days(CAST(c_custkey % 300 AS INTEGER)) AS updated_at,
         c_custkey % 2 = 0 AS verified
  FROM seg
),
teachers AS (
  SELECT p_partkey AS id, 'T-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, len(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS teacher_code,
         p_name AS full_name, 't' || CAST(p_partkey AS VARCHAR) || '@example.org' AS email,
         CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS cv_link,
         p_brand AS current_job_title,
         CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS subjects,
         p_type AS highest_qualification,
         CAST(NULL AS VARCHAR) AS current_country, CAST(NULL AS VARCHAR) AS current_region,
         CAST(NULL AS VARCHAR) AS visa_status, CAST(NULL AS VARCHAR) AS notice_period,
         FALSE AS will_move_sem1, FALSE AS will_move_sem2,
         CAST(p_size AS INTEGER) AS years_experience,
         CAST(NULL AS VARCHAR) AS preferred_regions, CAST(NULL AS VARCHAR) AS bio,
         CAST(NULL AS VARCHAR) AS current_school_name,
         CASE p_size % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'INACTIVE' ELSE 'PLACED' END AS profile_status,
         p_size % 4 <> 0 AS is_visible_in_school_portal,
         {AS_OF} - to_days(CAST(p_partkey % 400 AS INTEGER)) AS created_at,
         {AS_OF} - to_days(CAST(p_partkey % 400 AS INTEGER)) AS updated_at
  FROM part
),
teacher_views AS (
  SELECT event_id AS id, k AS teacher_id, user_id AS school_id, ts AS viewed_at FROM ev WHERE event_type = 'view'
),
requests AS (
  SELECT event_id AS id, k AS teacher_id, user_id AS school_id, ts AS requested_at,
         CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'TEACHER_CONTACTED' WHEN 2 THEN 'TEACHER_ACCEPTED'
              WHEN 3 THEN 'TEACHER_DECLINED' ELSE 'CLOSED' END AS status,
         CASE WHEN event_id % 3 <> 0 THEN 'Message ' || CAST(event_id AS VARCHAR) END AS school_message,
         CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE 'note' END AS admin_notes
  FROM ev WHERE event_type = 'purchase'
),
access_codes AS (
  SELECT 'C' || CAST(event_id AS VARCHAR) AS id, 'C' || CAST(event_id AS VARCHAR) AS code,
         CASE WHEN event_id % 3 <> 0 AND user_id % 2 = 1 THEN user_id END AS school_id,
         CASE event_id % 3 WHEN 0 THEN 'UNUSED' WHEN 1 THEN 'ACTIVE' ELSE 'EXPIRED' END AS status,
         ts AS created_at,
         CASE WHEN event_id % 3 <> 0 THEN ts END AS first_used_at,
         CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 24 HOUR END AS expires_at
  FROM ev WHERE event_type = 'signup'
),
redeem_attempts AS (
  SELECT event_id AS seq, user_id AS school_id, 'C' || CAST(event_id // 3 AS VARCHAR) AS code, ts
  FROM ev WHERE event_type = 'click'
),
feed AS (
  SELECT *, event_id AS seq, event_id % 10 AS slot, CAST(floor(event_id / 10) AS BIGINT) AS n
  FROM ev WHERE event_type = 'error'
),
li_views AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS id, l.l_partkey AS teacher_id, o.o_custkey AS school_id,
         l.l_shipdate AS viewed_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
li_requests AS (
  SELECT o_orderkey AS id, o_custkey AS school_id, o_orderdate AS requested_at FROM orders
)"""


def with_base(body: str, recursive: bool = False) -> str:
    """``body`` is either ``SELECT ...`` or extra CTEs ``, x AS (...) SELECT ...``."""
    body = body.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    if body.startswith(","):
        return f"{head} {BASE}{body}"
    return f"{head} {BASE}\n{body}"


LI_AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"


def win(col: str, days, as_of: str = AS_OF) -> str:
    """Rolling-window predicate; ``days=None`` means the whole log."""
    if days is None:
        return "TRUE"
    return f"{col} > {as_of} - INTERVAL {days} DAY"


def period_totals(days: int, views="teacher_views", reqs="requests", as_of=AS_OF) -> str:
    return with_base(f"""
, happened AS (
  SELECT school_id AS viewer, 0 AS asked FROM {views} WHERE {win('viewed_at', days, as_of)}
  UNION ALL
  SELECT NULL, 1 FROM {reqs} WHERE {win('requested_at', days, as_of)}),
tally AS (SELECT count(*) FILTER (asked = 0) AS views, count(*) FILTER (asked = 1) AS requests,
                 count(DISTINCT viewer) AS active_schools FROM happened)
SELECT *, COALESCE(round(CAST(requests AS DOUBLE) / nullif(views, 0) * 100, 1), 0.0) AS conversion FROM tally
""")


def daily_activity(days: int, views="teacher_views", reqs="requests", as_of=AS_OF) -> str:
    return with_base(f"""
, happened AS (
  SELECT CAST(viewed_at AS DATE) AS on_day, TRUE AS is_view FROM {views} WHERE {win('viewed_at', days, as_of)}
  UNION ALL
  SELECT CAST(requested_at AS DATE), FALSE FROM {reqs} WHERE {win('requested_at', days, as_of)}),
spine AS (SELECT CAST({as_of} AS DATE) - CAST(back AS INTEGER) AS day FROM range(0, {days} + 1) AS steps(back))
SELECT day, strftime(day, '%a') AS name, strftime(day, '%Y-%m-%d') AS full_date,
       count(on_day) FILTER (WHERE is_view) AS views, count(on_day) FILTER (WHERE NOT is_view) AS requests
FROM spine LEFT JOIN happened ON on_day = day
GROUP BY day
""")


def _most_viewed(key: str, days, views: str, as_of: str) -> str:
    """The log counted by one key alone, then placed; names are looked up for the five that remain."""
    return f"""
, hits AS (SELECT {key}, count(*) AS n FROM {views} WHERE {win('viewed_at', days, as_of)} GROUP BY {key}
           HAVING {key} IN (SELECT id FROM {key.removesuffix('_id')}s)),
placed AS (SELECT {key}, n, row_number() OVER (ORDER BY n DESC, {key}) AS place FROM hits)"""


def top_schools(days, views="teacher_views", as_of=AS_OF) -> str:
    return with_base(_most_viewed("school_id", days, views, as_of) + """
SELECT school_id, name, country AS location, n AS views
FROM placed, schools WHERE place <= 5 AND id = school_id
""")


def top_teachers(days, views="teacher_views", as_of=AS_OF) -> str:
    return with_base(_most_viewed("teacher_id", days, views, as_of) + """
SELECT teacher_id, teacher_code AS code, full_name AS name, n AS hits
FROM placed, teachers WHERE place <= 5 AND id = teacher_id
""")


def region_share(days, views="teacher_views", as_of=AS_OF) -> str:
    return with_base(f"""
, per_school AS (SELECT school_id, count(*) AS n FROM {views} WHERE {win('viewed_at', days, as_of)} GROUP BY ALL),
named AS (SELECT COALESCE(region, country, 'Other') AS name, CAST(sum(n) AS BIGINT) AS value
          FROM schools JOIN per_school ON school_id = id GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) - 1 AS place FROM named)
SELECT CAST(place AS INTEGER) AS rank, name, value,
       ['#3b82f6', '#10b981', '#f59e0b', '#64748b', '#8b5cf6'][place % 5 + 1] AS color
FROM placed WHERE place < 5
""")


DASHBOARD_COUNTS = with_base("""
, held AS (
  SELECT 'school' AS kind, subscription_status AS state FROM schools
  UNION ALL SELECT 'teacher', profile_status FROM teachers
  UNION ALL SELECT 'request', status FROM requests)
SELECT count(*) FILTER (kind = 'school' AND state = 'TRIAL') AS active_trials,
       count(*) FILTER (kind = 'school' AND state = 'ACTIVE') AS paid_subscriptions,
       count(*) FILTER (kind = 'school') AS total_schools,
       count(*) FILTER (kind = 'teacher' AND state = 'ACTIVE') AS total_teachers,
       count(*) FILTER (kind = 'request' AND state = 'PENDING') AS pending_requests
FROM held
""")

def _joined_by_month(table: str) -> str:
    return f"""SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS n FROM {table}
               WHERE created_at > {AS_OF} - INTERVAL 6 MONTH GROUP BY 1"""


MONTHLY_GROWTH = with_base(f"""
, new_teachers AS ({_joined_by_month("teachers")}), new_schools AS ({_joined_by_month("schools")})
SELECT month, strftime(month, '%b') AS name, COALESCE(new_teachers.n, 0) AS teachers,
       COALESCE(new_schools.n, 0) AS schools
FROM new_teachers FULL JOIN new_schools USING (month)
""")

RECENT_REQUESTS = with_base("""
, latest AS (
  SELECT * FROM requests
  WHERE school_id IN (SELECT id FROM schools) AND teacher_id IN (SELECT id FROM teachers)
  QUALIFY row_number() OVER (ORDER BY requested_at DESC, id DESC) <= 5)
SELECT id, (SELECT name FROM schools WHERE schools.id = school_id) AS school_name,
       (SELECT teachers.teacher_code FROM teachers WHERE teachers.id = teacher_id) AS teacher_code, requested_at, status
FROM latest
""")


# ---- Q9-Q19 -------------------------------------------------------------------

#: Requests with what is known of both sides; a side that isn't known is null.
_FOUND = """
, teacher_card AS (SELECT id AS teacher_id, teacher_code, full_name AS teacher_name FROM teachers),
school_card AS (SELECT id AS school_id, name AS school_name, email AS school_email FROM schools),
found AS (
  SELECT id, teacher_id, school_id, status, admin_notes, school_message, requested_at, teacher_code, teacher_name,
         school_name, school_email
  FROM requests LEFT JOIN teacher_card USING (teacher_id) LEFT JOIN school_card USING (school_id))
"""

REQUEST_SEARCH = with_base(_FOUND + "SELECT * FROM found")
REQUEST_SEARCH_PENDING = with_base(_FOUND + "SELECT * FROM found WHERE status = 'PENDING'")
REQUEST_SEARCH_TEXT = with_base(_FOUND + """SELECT * FROM found
WHERE contains(lower(concat_ws(chr(0), school_name, teacher_code, school_email)), 'customer#00000001')""")

REQUEST_DETAIL = with_base(_FOUND + "SELECT * EXCLUDE (school_message, school_email) FROM found")

_REVEALED = ["full_name", "email", "phone", "cv_link", "current_job_title", "highest_qualification",
             "current_country", "current_region", "visa_status", "notice_period", "will_move_sem1",
             "will_move_sem2", "years_experience", "preferred_regions", "profile_status"]


def _accepted(fields) -> str:
    """The revealed columns of accepted requests only; every other request meets nothing there."""
    return f"""
, revealed AS (
  SELECT requests.id, {", ".join(f"teachers.{f} AS teacher_{f}" for f in fields)}
  FROM requests, teachers WHERE teachers.id = teacher_id AND status = 'TEACHER_ACCEPTED'),
shown AS (SELECT id AS teacher_id, teacher_code, subjects FROM teachers)"""


_ANSWER = "ifnull(admin_notes, 'No response by admin still now') AS admin_notes"

SCHOOL_REQUEST_FEED = with_base(_accepted(_REVEALED) + f"""
SELECT id, teacher_id, school_id, teacher_code, requested_at, status, school_message, {_ANSWER}, subjects,
       {", ".join(f"teacher_{f}" for f in _REVEALED)}
FROM requests JOIN shown USING (teacher_id) LEFT JOIN revealed USING (id)
""")

_DETAIL_FIELDS = _REVEALED[:5] + ["subjects"] + _REVEALED[5:]
SCHOOL_REQUEST_DETAIL = with_base(_accepted(_DETAIL_FIELDS) + f"""
SELECT id, teacher_id, teacher_code, requested_at, status, school_message, {_ANSWER},
       {", ".join(f"teacher_{f}" for f in _DETAIL_FIELDS)}
FROM requests JOIN shown USING (teacher_id) LEFT JOIN revealed USING (id)
""")

PORTAL_TEACHER_LIST = with_base("""
SELECT id, teacher_code, highest_qualification, years_experience, current_country, visa_status, profile_status, bio
FROM teachers WHERE is_visible_in_school_portal = TRUE
""")

PORTAL_TEACHER_DETAIL = with_base("""
SELECT teacher_code, highest_qualification, current_country, current_region, years_experience, subjects, profile_status
FROM teachers WHERE is_visible_in_school_portal = TRUE
""")

PORTAL_TEACHER_SUBJECT = PORTAL_TEACHER_LIST.rstrip() + " AND subjects ILIKE '%ring%'"

TEACHER_EXPORT = with_base("SELECT * FROM teachers ORDER BY created_at DESC")
SCHOOL_EXPORT = with_base("SELECT * FROM schools")

ACCESS_CODE_REPORT = with_base("""
, holder AS (SELECT id AS school_id, name AS school_name, email FROM schools)
SELECT id, code, status, school_id, first_used_at, expires_at, created_at, school_name, email
FROM access_codes LEFT JOIN holder USING (school_id)
""")

SUBSCRIPTION_STATUS_REPORT = with_base("""
SELECT id AS school_id, subscription_status,
       strftime(subscription_end_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS subscription_end_at
FROM schools
""")

PLAN_CHANGE_CHECK = with_base(f"""
, wants AS (
  SELECT seq, user_id AS school_id,
         CASE k % 5 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'PRO' WHEN 2 THEN 'ULTIMATE' WHEN 3 THEN 'GOLD' END AS requested_plan
  FROM feed WHERE slot = 9
), cur AS (
  SELECT id AS school_id,
         CASE WHEN subscription_status = 'ACTIVE' AND (subscription_end_at IS NULL OR subscription_end_at > {AS_OF})
              THEN subscription_plan END AS current_plan
  FROM schools
), decided AS (
  SELECT w.seq, w.school_id, w.requested_plan, c.current_plan,
         CASE WHEN w.requested_plan IS NULL OR w.requested_plan = '' THEN 'Missing planId'
              WHEN c.current_plan IS NULL THEN NULL
              WHEN c.current_plan = 'BASIC' THEN
                CASE WHEN w.requested_plan IN ('PRO', 'ULTIMATE') THEN NULL
                     ELSE 'You already have BASIC. You can only upgrade to PRO or ULTIMATE.' END
              WHEN c.current_plan = 'PRO' THEN
                CASE WHEN w.requested_plan = 'ULTIMATE' THEN NULL
                     ELSE 'You already have PRO. You can only upgrade to ULTIMATE.' END
              WHEN c.current_plan = 'ULTIMATE' THEN
                'You already have ULTIMATE. You must cancel or let it expire before buying another plan.'
              ELSE 'Unknown current subscription plan.' END AS reason
  FROM wants w LEFT JOIN cur c ON w.school_id = c.school_id
)
SELECT seq, school_id, requested_plan, current_plan, reason IS NULL AS allowed, reason FROM decided
""")

ENTITLEMENT_REPORT = with_base(f"""
SELECT school_id, code IS NULL AS allowed, code FROM (
  SELECT id AS school_id,
         CASE WHEN subscription_started_at IS NULL OR subscription_end_at IS NULL THEN 'SUBSCRIPTION_REQUIRED'
              WHEN subscription_end_at < {AS_OF} THEN 'SUBSCRIPTION_EXPIRED'
              WHEN subscription_status NOT IN ('TRIAL', 'ACTIVE') THEN 'SUBSCRIPTION_REQUIRED' END AS code
  FROM schools) x
""")

ACCESS_CODE_CHECK = with_base("""
SELECT a.seq, a.code,
       EXISTS (SELECT 1 FROM access_codes c WHERE c.code = a.code AND c.status = 'UNUSED') AS valid,
       CASE WHEN a.code IS NULL OR a.code = '' THEN 'Code is required'
            WHEN EXISTS (SELECT 1 FROM access_codes c WHERE c.code = a.code AND c.status = 'UNUSED')
              THEN 'Access code is valid'
            ELSE 'Invalid or already used access code' END AS message
FROM redeem_attempts a
""")


def _dup(name, table, key):
    return f"""SELECT '{name}' AS check_name, COUNT(*) AS violating_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violating_rows
FROM (SELECT {key}, COUNT(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING COUNT(*) > 1) d"""


def _orphan(name, table, fk, dim, extra=""):
    return f"""SELECT '{name}' AS check_name, COUNT(*) AS violating_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violating_rows
FROM (SELECT f.{fk}, COUNT(*) AS n FROM {table} f WHERE {extra or 'TRUE'}
      AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.id = f.{fk}) GROUP BY f.{fk}) o"""


def _enum(name, table, col, domain, nullable):
    dom = ", ".join(f"'{v}'" for v in domain)
    cond = f"{col} IS NOT NULL AND {col} NOT IN ({dom})" if nullable else f"{col} IS NULL OR {col} NOT IN ({dom})"
    return f"""SELECT '{name}' AS check_name, COUNT(*) AS violating_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violating_rows
FROM (SELECT {col}, COUNT(*) AS n FROM {table} WHERE {cond} GROUP BY {col}) e"""


def _constraints(schools: str = "schools", teachers: str = "teachers", codes: str = "access_codes") -> str:
    return "\nUNION ALL\n".join([
        _dup("schools.email unique", schools, "email"),
        _dup("teachers.teacher_code unique", teachers, "teacher_code"),
        _dup("access_codes.code unique", codes, "code"),
        _orphan("requests.teacher_id references teachers", "requests", "teacher_id", teachers),
        _orphan("requests.school_id references schools", "requests", "school_id", schools),
        _orphan("teacher_views.teacher_id references teachers", "teacher_views", "teacher_id", teachers),
        _orphan("teacher_views.school_id references schools", "teacher_views", "school_id", schools),
        _orphan("access_codes.school_id references schools", codes, "school_id", schools,
                "f.school_id IS NOT NULL"),
        _enum("schools.subscription_status enum", schools, "subscription_status",
              ["NO_SUBSCRIPTION", "TRIAL", "ACTIVE", "EXPIRED"], False),
        _enum("schools.subscription_plan enum", schools, "subscription_plan", ["BASIC", "PRO", "ULTIMATE"], True),
        _enum("teachers.profile_status enum", teachers, "profile_status", ["ACTIVE", "INACTIVE", "PLACED"], False),
        _enum("access_codes.status enum", codes, "status", ["UNUSED", "ACTIVE", "EXPIRED"], False),
        _enum("requests.status enum", "requests", "status",
              ["PENDING", "TEACHER_CONTACTED", "TEACHER_ACCEPTED", "TEACHER_DECLINED", "CLOSED"], False),
    ])


CONSTRAINT_REPORT = with_base(_constraints())

_FORMER = "created_at < TIMESTAMP '2023-12-12 00:00:00'"

# The former snapshot restored twice, the second time under new ids and with its enum values in lower case.
CONSTRAINT_REPORT_RESTORED = with_base(f"""
, once AS (SELECT * FROM schools WHERE {_FORMER})
, r_schools AS (
  FROM once UNION ALL
  SELECT * REPLACE (id + 1000000 AS id, lower(subscription_status) AS subscription_status,
                    lower(subscription_plan) AS subscription_plan) FROM once)
, r_teachers AS (
  SELECT id, teacher_code, profile_status FROM teachers WHERE {_FORMER} UNION ALL
  SELECT id + 1000000, teacher_code, lower(profile_status) FROM teachers WHERE {_FORMER})
, r_codes AS (
  SELECT code, status, school_id FROM access_codes UNION ALL SELECT code, lower(status), school_id FROM access_codes)
""" + _constraints("r_schools", "r_teachers", "r_codes"))

VIEW_LOG = with_base("SELECT id, teacher_id, school_id, viewed_at FROM teacher_views ORDER BY viewed_at, id")


# ---- S1-S4: streams (final state) ----------------------------------------------------

VIEW_INGEST = with_base("""
SELECT id, teacher_id, school_id, viewed_at FROM teacher_views
WHERE teacher_id IN (SELECT id FROM teachers) AND school_id IN (SELECT id FROM schools)
""")

VIEW_INGEST_QUARANTINE = with_base("""
SELECT id, teacher_id, school_id, viewed_at, 'Teacher not found' AS reason FROM teacher_views
WHERE teacher_id NOT IN (SELECT id FROM teachers)
UNION ALL
SELECT id, teacher_id, school_id, viewed_at, 'School not found' AS reason FROM teacher_views
WHERE teacher_id IN (SELECT id FROM teachers) AND school_id NOT IN (SELECT id FROM schools)
""")

def _held_back(teachers: str, schools: str) -> str:
    return with_base(f"""
SELECT id, teacher_id, school_id, viewed_at,
       CASE WHEN t.known IS NULL THEN 'Teacher not found' ELSE 'School not found' END AS reason
FROM teacher_views
LEFT JOIN (SELECT id AS teacher_id, 1 AS known FROM teachers WHERE {teachers}) t USING (teacher_id)
LEFT JOIN (SELECT id AS school_id, 1 AS known FROM schools WHERE {schools}) s USING (school_id)
WHERE t.known IS NULL OR s.known IS NULL
""")


VIEW_INGEST_EARLY_QUARANTINE = _held_back(_FORMER, _FORMER)
VIEW_INGEST_TEACHERS_ARRIVED = _held_back("true", _FORMER)

LIVE_DAILY_COUNTS = with_base("""
SELECT day, CAST(SUM(v) AS BIGINT) AS views, CAST(SUM(r) AS BIGINT) AS requests
FROM (SELECT CAST(viewed_at AS DATE) AS day, 1 AS v, 0 AS r FROM teacher_views
      UNION ALL
      SELECT CAST(requested_at AS DATE), 0, 1 FROM requests) x
GROUP BY day
""")

# A day is closed when the watermark, a day behind the newest event of either kind, is past its end.
LIVE_DAILY_COUNTS_CLOSED = """
    SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS views,
           count(*) FILTER (event_type = 'purchase') AS requests
    FROM events WHERE event_type IN ('view', 'purchase') GROUP BY day
    HAVING ts::DATE + INTERVAL 2 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'purchase'))"""

LIVE_TOP_SCHOOLS = top_schools(None)

LIVE_ACTIVE_SCHOOLS = """
    WITH pairs AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events WHERE event_type = 'view')
    SELECT day, count(user_id) AS active_schools FROM pairs GROUP BY day"""

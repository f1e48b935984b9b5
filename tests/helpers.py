"""Tiny literal domain tables for edge-case tests."""

from __future__ import annotations

import datetime as dt

from chalkline.sources import schemas as sch

AS_OF = dt.datetime(2024, 1, 31)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def _frame(spark, schema, rows, defaults):
    full = []
    for r in rows:
        d = dict(defaults)
        d.update(r)
        full.append(tuple(d.get(f.name) for f in schema.fields))
    return spark.createDataFrame(full, schema)


def schools(spark, rows):
    defaults = {"name": "S", "contact_name": "C", "email": None, "subscription_status": "NO_SUBSCRIPTION",
                "created_at": AS_OF, "updated_at": AS_OF, "verified": False}
    rows = [dict(r, email=r.get("email", f"s{r['id']}@x.org"), name=r.get("name", f"School {r['id']}"))
            for r in rows]
    return _frame(spark, sch.SCHOOLS, rows, defaults)


def teachers(spark, rows):
    defaults = {"full_name": "T", "email": "t@x.org", "will_move_sem1": False, "will_move_sem2": False,
                "profile_status": "ACTIVE", "is_visible_in_school_portal": True,
                "created_at": AS_OF, "updated_at": AS_OF}
    rows = [dict(r, teacher_code=r.get("teacher_code", f"T-{r['id']:05d}")) for r in rows]
    return _frame(spark, sch.TEACHERS, rows, defaults)


def views(spark, rows):
    return _frame(spark, sch.TEACHER_VIEWS, [dict(r, id=r.get("id", i)) for i, r in enumerate(rows)], {})


def requests(spark, rows):
    defaults = {"status": "PENDING", "requested_at": AS_OF}
    return _frame(spark, sch.REQUESTS, [dict(r, id=r.get("id", i)) for i, r in enumerate(rows)], defaults)


def codes(spark, rows):
    defaults = {"status": "UNUSED", "created_at": AS_OF}
    return _frame(spark, sch.ACCESS_CODES, [dict(r, id=r.get("id", r["code"])) for r in rows], defaults)

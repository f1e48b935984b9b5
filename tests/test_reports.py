"""Edge cases for reports, masking and rules (Q9-Q19)."""

import datetime as dt

import pytest

from chalkline.functions.text import like_contains
from chalkline.operators import directory as D
from chalkline.operators import requests as R
from chalkline.operators import rules as U
from tests import helpers as H

AS_OF = H.AS_OF


def test_request_search_filters(spark):
    s = H.schools(spark, [{"id": 1, "name": "North 100% School", "email": "a_b@x.org"}, {"id": 2, "name": "South"}])
    t = H.teachers(spark, [{"id": 1}])
    r = H.requests(spark, [{"id": 1, "teacher_id": 1, "school_id": 1}, {"id": 2, "teacher_id": 7, "school_id": 2,
                                                                         "status": "CLOSED"}])
    assert R.request_search(r, t, s).count() == 2                      # orphan teacher kept
    assert R.request_search(r, t, s, status="ALL").count() == 2
    assert [x.id for x in R.request_search(r, t, s, status="CLOSED").collect()] == [2]
    with pytest.raises(ValueError):
        R.request_search(r, t, s, status="BOGUS")
    assert [x.id for x in R.request_search(r, t, s, search="100%").collect()] == [1]
    assert [x.id for x in R.request_search(r, t, s, search="a_b").collect()] == [1]
    assert [x.id for x in R.request_search(r, t, s, search="NORTH").collect()] == [1]
    assert R.request_search(r, t, s, search="so\\uth").count() == 1  # backslash before a letter: literal letter
    orphan = R.request_search(r, t, s, status="CLOSED").first()
    assert orphan.teacher_code is None and orphan.school_name == "South"


def test_like_contains_escapes():
    assert like_contains("a%b") == "%a%b%"
    assert like_contains("a\\xb") == "%axb%"
    assert like_contains("a\\%") == "%a\\%%"
    assert like_contains("end\\") == "%end\\\\%"


def test_feed_masking(spark):
    t = H.teachers(spark, [{"id": 1, "subjects": "Maths", "phone": "123"}])
    r = H.requests(spark, [{"id": 1, "teacher_id": 1, "school_id": 5, "status": "TEACHER_ACCEPTED", "admin_notes": ""},
                           {"id": 2, "teacher_id": 1, "school_id": 5, "status": "PENDING"}])
    rows = {x.id: x for x in R.school_request_feed(r, t).collect()}
    assert rows[1].teacher.phone == "123" and rows[1].admin_notes == ""
    assert rows[2].teacher is None and rows[2].subjects == "Maths"
    assert rows[2].admin_notes == R.NO_ADMIN_RESPONSE
    d = {x.id: x for x in R.school_request_feed(r, t, detail=True).collect()}
    assert "school_id" not in d[1].asDict() and d[1].teacher.subjects == "Maths"
    assert [x.id for x in R.school_request_feed(r, t, request_ids=[2]).collect()] == [2]


def test_portal_list_has_no_personal_data(spark):
    t = H.teachers(spark, [{"id": 1, "subjects": "Physics", "current_region": "EU"},
                           {"id": 2, "is_visible_in_school_portal": False}])
    out = D.portal_teacher_list(t, seed=1)
    assert set(out.columns).isdisjoint({"full_name", "email", "phone", "cv_link"})
    assert [x.id for x in out.collect()] == [1]
    assert D.portal_teacher_list(t, subjects="phys", region="EU").count() == 1
    assert D.portal_teacher_list(t, ids=[2], detail=True).count() == 0


@pytest.mark.parametrize("status,end,plan,want,allowed", [
    ("ACTIVE", None, "BASIC", "PRO", True),
    ("ACTIVE", None, "BASIC", "BASIC", False),
    ("ACTIVE", None, "PRO", "ULTIMATE", True),
    ("ACTIVE", None, "PRO", "BASIC", False),
    ("ACTIVE", None, "ULTIMATE", "ULTIMATE", False),
    ("ACTIVE", dt.datetime(2024, 1, 1), "ULTIMATE", "BASIC", True),   # expired: no current plan
    ("TRIAL", None, "BASIC", "GOLD", True),                             # no plan: anything goes
    ("ACTIVE", None, "BASIC", None, False),                             # missing request
])
def test_plan_change(spark, status, end, plan, want, allowed):
    s = H.schools(spark, [{"id": 1, "subscription_status": status, "subscription_end_at": end,
                           "subscription_plan": plan}])
    w = spark.createDataFrame([(1, 1, want)], "seq long, school_id long, requested_plan string")
    assert U.plan_change_check(s, w, AS_OF).first().allowed is allowed


def test_entitlement_order(spark):
    s = H.schools(spark, [
        {"id": 1, "subscription_status": "ACTIVE", "subscription_started_at": AS_OF},          # missing end
        {"id": 2, "subscription_status": "ACTIVE", "subscription_started_at": AS_OF, "subscription_end_at": AS_OF},
        {"id": 3, "subscription_status": "EXPIRED", "subscription_started_at": AS_OF,
         "subscription_end_at": AS_OF + dt.timedelta(days=3)},
        {"id": 4, "subscription_status": "TRIAL", "subscription_started_at": AS_OF,
         "subscription_end_at": AS_OF - dt.timedelta(seconds=1)},
    ])
    out = {x.school_id: x.code for x in U.entitlement_report(s, AS_OF).collect()}
    assert out == {1: "SUBSCRIPTION_REQUIRED", 2: None, 3: "SUBSCRIPTION_REQUIRED", 4: "SUBSCRIPTION_EXPIRED"}


def test_status_report_iso(spark):
    s = H.schools(spark, [{"id": 1, "subscription_end_at": dt.datetime(2024, 2, 1, 13, 5, 9, 123000)}, {"id": 2}])
    out = {x.school_id: x.subscription_end_at for x in U.subscription_status_report(s).collect()}
    assert out == {1: "2024-02-01T13:05:09.123Z", 2: None}


def test_access_code_check(spark):
    c = H.codes(spark, [{"code": "A"}, {"code": "B", "status": "ACTIVE"}, {"code": "D"}, {"code": "D", "id": "D2"}])
    a = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Z"), (4, ""), (5, "D")], "seq long, code string")
    out = {x.seq: (x.valid, x.message) for x in U.access_code_check(a, c).collect()}
    assert out[1][0] and not out[2][0] and not out[3][0] and out[4][1] == U.CODE_REQUIRED
    assert out[5][0] and len(out) == 5          # a duplicated code does not duplicate the attempt


def test_constraint_report_counts(spark):
    s = H.schools(spark, [{"id": 1, "email": "same@x.org"}, {"id": 2, "email": "same@x.org"},
                          {"id": 3, "subscription_status": "CANCELLED"}])
    t = H.teachers(spark, [{"id": 1}])
    c = H.codes(spark, [{"code": "A", "school_id": 77}])
    r = H.requests(spark, [{"teacher_id": 5, "school_id": 1}, {"teacher_id": 5, "school_id": 1}])
    v = H.views(spark, [{"teacher_id": 1, "school_id": 9, "viewed_at": AS_OF}])
    out = {x.check_name: (x.violating_keys, x.violating_rows) for x in U.constraint_report(s, t, c, r, v).collect()}
    assert out["schools.email unique"] == (1, 2)
    assert out["requests.teacher_id references teachers"] == (1, 2)
    assert out["teacher_views.school_id references schools"] == (1, 1)
    assert out["access_codes.school_id references schools"] == (1, 1)
    assert out["schools.subscription_status enum"] == (1, 1)
    assert out["teachers.teacher_code unique"] == (0, 0)


def test_view_log_filters(spark):
    v = H.views(spark, [{"teacher_id": 1, "school_id": 1, "viewed_at": AS_OF},
                        {"teacher_id": 2, "school_id": 1, "viewed_at": AS_OF - dt.timedelta(hours=1)}])
    assert [x.teacher_id for x in U.view_log(v).collect()] == [2, 1]
    assert U.view_log(v, teacher_ids=[1]).count() == 1
    ids = spark.createDataFrame([(1,)], "school_id long")
    assert U.view_log(v, school_ids=ids).count() == 2

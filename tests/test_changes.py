"""Edge cases and invariants for the change-feed jobs (M1-M4, M6-M11)."""

import datetime as dt

from pyspark.sql import functions as F

from chalkline.operators import changes as C
from chalkline.operators import directory as D
from tests import helpers as H

AS_OF = H.AS_OF
PATCH = "seq long, id long, changes map<string,string>, ts timestamp_ntz"


def test_expire_idempotent(spark):
    s = H.schools(spark, [
        {"id": 1, "subscription_status": "ACTIVE", "subscription_end_at": AS_OF},                       # kept
        {"id": 2, "subscription_status": "ACTIVE", "subscription_end_at": AS_OF - dt.timedelta(days=1)},
        {"id": 3, "subscription_status": "NO_SUBSCRIPTION", "subscription_end_at": AS_OF - dt.timedelta(hours=1)},
        {"id": 4, "subscription_status": "TRIAL"},                                                      # null end
    ])
    once = C.expire_subscriptions(s, AS_OF)
    got = {x.id: x.subscription_status for x in once.collect()}
    assert got == {1: "ACTIVE", 2: "EXPIRED", 3: "EXPIRED", 4: "TRIAL"}
    twice = C.expire_subscriptions(once, AS_OF)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_archive_cascade_and_rejects(spark):
    t = H.teachers(spark, [{"id": 1, "bio": "secret"}, {"id": 2}])
    r = H.requests(spark, [{"teacher_id": 1, "school_id": 1}, {"teacher_id": 2, "school_id": 1}])
    v = H.views(spark, [{"teacher_id": 1, "school_id": 1, "viewed_at": AS_OF}])
    d = spark.createDataFrame([(5, 1), (6, 99), (7, 1)], "seq long, id long")
    arch, tl, rl, vl, rej = C.archive_teachers(t, r, v, d, as_of=AS_OF)
    a = arch.collect()
    assert len(a) == 1 and a[0].original_teacher_id == 1 and "bio" not in arch.columns
    assert a[0].archived_at == AS_OF
    assert tl.count() + arch.count() == t.count()                                      # invariant
    assert (rl.count(), vl.count()) == (1, 0)
    assert sorted(x.seq for x in rej.collect()) == [6, 7]
    assert rej.count() + arch.count() == d.count()                                     # accepted + rejected = feed


def test_teacher_patches_absent_vs_null(spark):
    t = H.teachers(spark, [{"id": 1, "subjects": "Old", "bio": "b", "years_experience": 3}])
    p = spark.createDataFrame([
        (1, 1, {"subjects": "New"}, dt.datetime(2024, 1, 2)),
        (2, 1, {"bio": None, "years_experience": "9"}, dt.datetime(2024, 1, 3)),
        (3, 1, {"subjects": "Newer", "teacher_code": "HACK"}, dt.datetime(2024, 1, 4)),
        (4, 8, {"subjects": "x"}, dt.datetime(2024, 1, 5)),
    ], PATCH)
    new, rej = C.apply_teacher_patches(t, p)
    row = new.first()
    assert (row.subjects, row.bio, row.years_experience, row.teacher_code) == ("Newer", None, 9, "T-00001")
    assert row.updated_at == dt.datetime(2024, 1, 4)
    assert [x.seq for x in rej.collect()] == [4]


def test_school_patches_email_rules(spark):
    s = H.schools(spark, [{"id": 1, "email": "a@x.org"}, {"id": 2, "email": "b@x.org"}, {"id": 3, "email": "c@x.org"}])
    p = spark.createDataFrame([
        (1, 1, {"email": "b@x.org"}, AS_OF),            # taken by school 2 in the snapshot
        (2, 3, {"email": "new@x.org"}, AS_OF),          # first claim wins
        (3, 2, {"email": "new@x.org"}, AS_OF),          # lost to seq 2
        (4, 2, {}, AS_OF),                               # empty patch
        (5, 1, {"description": "About", "phone": None}, AS_OF),
        (6, 1, {"email": "a@x.org"}, AS_OF),            # own address: fine
    ], PATCH)
    new, rej = C.apply_school_patches(s, p)
    got = {x.id: x for x in new.collect()}
    assert got[3].email == "new@x.org" and got[2].email == "b@x.org"
    assert got[1].about == "About" and got[1].email == "a@x.org"
    reasons = {x.seq: x.reason for x in rej.collect()}
    assert reasons == {1: C.EMAIL_IN_USE, 3: C.EMAIL_IN_USE, 4: C.NO_FIELDS}


def test_school_patches_swap_needs_two_batches(spark):
    s = H.schools(spark, [{"id": 1, "email": "a@x.org"}, {"id": 2, "email": "b@x.org"}])
    p = spark.createDataFrame([(1, 1, {"email": "b@x.org"}, AS_OF), (2, 2, {"email": "a@x.org"}, AS_OF)], PATCH)
    _, rej = C.apply_school_patches(s, p)
    assert rej.count() == 2


def test_paid_plans_month_overflow(spark):
    s = H.schools(spark, [{"id": 1, "email": "a@x.org"}, {"id": 2, "email": "b@x.org"}])
    ev = spark.createDataFrame([
        (1, "cs1", 1, "a@x.org", "BASIC", "paid", dt.datetime(2024, 1, 31, 10, 0)),
        (2, "cs1", 1, "a@x.org", "PRO", "paid", dt.datetime(2024, 2, 1)),        # replayed session
        (3, "cs2", 2, "wrong@x.org", "PRO", "paid", dt.datetime(2024, 2, 1)),
        (4, "cs3", 2, "b@x.org", "PRO", "unpaid", dt.datetime(2024, 2, 1)),
        (5, "cs4", 2, "b@x.org", "GOLD", "paid", dt.datetime(2024, 2, 1)),
    ], "seq long, session_id string, school_id long, email string, plan string, payment_status string, "
       "ts timestamp_ntz")
    new, rej = C.activate_paid_plans(s, ev)
    one = new.filter("id = 1").first()
    assert one.subscription_end_at == dt.datetime(2024, 3, 2, 10, 0) and one.subscription_plan == "BASIC"
    assert {x.seq: x.reason for x in rej.collect()} == {
        2: C.DUPLICATE_SESSION, 3: C.PLAN_SCHOOL_MISMATCH, 4: C.PAYMENT_INCOMPLETE, 5: C.INVALID_PLAN}


def test_override_and_cancel(spark):
    s = H.schools(spark, [{"id": 1, "subscription_status": "ACTIVE", "subscription_plan": "PRO"}])
    o = spark.createDataFrame([(1, 1, "TRIAL", 48), (2, 1, "BOGUS", 5), (3, 1, "ACTIVE", 0), (4, 9, "ACTIVE", 1)],
                              "seq long, school_id long, status string, hours int")
    new, rej = C.override_subscription(s, o, as_of=AS_OF)
    row = new.first()
    assert (row.subscription_status, row.subscription_plan) == ("TRIAL", "PRO")
    assert row.subscription_end_at == AS_OF + dt.timedelta(hours=48)
    assert rej.count() == 3
    c = H.codes(spark, [{"code": "A", "school_id": 1, "status": "ACTIVE"}, {"code": "B"}])
    ns, nc, rej = C.cancel_subscriptions(s, c, spark.createDataFrame([(1, 1)], "seq long, id long"), as_of=AS_OF)
    row = ns.first()
    assert (row.subscription_status, row.subscription_plan, row.subscription_end_at) == ("NO_SUBSCRIPTION", None, AS_OF)
    assert {x.code: x.status for x in nc.collect()} == {"A": "EXPIRED", "B": "UNUSED"}
    # a cancelled school (end = now) is expired by the next hourly run
    assert C.expire_subscriptions(ns, AS_OF + dt.timedelta(hours=1)).first().subscription_status == "EXPIRED"


def test_request_events(spark):
    r = H.requests(spark, [{"id": 1, "teacher_id": 1, "school_id": 1, "admin_notes": None}])
    ev = spark.createDataFrame([
        (1, "create", 50, 2, 3, None, "", None),
        (2, "create", 51, 2, 3, None, "Hi", None),
        (3, "set_status", 1, None, None, "TEACHER_ACCEPTED", None, None),
        (4, "close", 1, 1, 99, None, None, None),                 # wrong school: ignored
        (5, "set_status", 1, None, None, None, None, "x"),        # null status: refused
        (6, "set_status", 77, None, None, "CLOSED", None, None),  # unknown id
    ], "seq long, kind string, request_id long, teacher_id long, school_id long, status string, message string, "
       "admin_notes string")
    new, rej = C.apply_request_events(r, ev, as_of=AS_OF)
    got = {x.id: x for x in new.collect()}
    assert got[1].status == "TEACHER_ACCEPTED" and got[1].admin_notes == ""
    assert got[50].school_message == C.DEFAULT_REQUEST_MESSAGE and got[51].school_message == "Hi"
    assert got[50].status == "PENDING"
    assert sorted(x.seq for x in rej.collect()) == [4, 5, 6]


def test_code_maintenance(spark):
    c = H.codes(spark, [{"code": "A"}])
    ops = spark.createDataFrame([
        (1, "create", "N1", None), (2, "create", "N1", None), (3, "create", "A", None), (4, "create", "", None),
        (5, "expire", None, "N1"), (6, "expire", None, "ZZ"), (0, "expire", None, "N1"),
    ], "seq long, op string, code string, id string")
    new, rej = C.maintain_access_codes(c, ops, as_of=AS_OF)
    assert {x.id: x.status for x in new.collect()} == {"A": "UNUSED", "N1": "EXPIRED"}
    assert {x.seq: x.reason for x in rej.collect()} == {
        2: C.CODE_EXISTS, 3: C.CODE_EXISTS, 4: C.CODE_REQUIRED, 6: C.CODE_NOT_FOUND, 0: C.CODE_NOT_FOUND}


def test_register_schools_without_codes(spark):
    s = H.schools(spark, [{"id": 10, "email": "taken@x.org"}])
    sign = spark.createDataFrame([
        (1, "A", "c", "New@X.org", None), (2, "B", "c", "new@x.org", None), (3, "C", "c", "TAKEN@x.org", None),
        (4, "", "c", "e@x.org", None), (5, "D", None, "f@x.org", None), (6, "E", "c", "bad email", None),
    ], "seq long, name string, contact_name string, email string, access_code string") \
        .withColumn("country", F.lit(None).cast("string")).withColumn("region", F.lit(None).cast("string"))
    ins, rej, _ = C.register_schools(s, sign, None, as_of=AS_OF)
    got = ins.collect()
    assert [(x.id, x.email, x.subscription_status) for x in got] == [(12, "new@x.org", "NO_SUBSCRIPTION")]
    assert {x.seq: x.reason for x in rej.collect()} == {
        2: C.EMAIL_TAKEN, 3: C.EMAIL_TAKEN, 4: C.INVALID_INPUT, 5: C.CONTACT_REQUIRED, 6: C.INVALID_INPUT}


def test_request_event_before_its_create_is_not_found(spark):
    r = H.requests(spark, [])
    ev = spark.createDataFrame([
        (1, "set_status", 50, None, None, "CLOSED", None, None),   # before the create
        (2, "create", 50, 2, 3, None, "Hi", None),
        (3, "set_status", 50, None, None, "TEACHER_CONTACTED", None, "ok"),
    ], "seq long, kind string, request_id long, teacher_id long, school_id long, status string, message string, "
       "admin_notes string")
    new, rej = C.apply_request_events(r, ev, as_of=AS_OF)
    row = new.first()
    assert (row.status, row.admin_notes) == ("TEACHER_CONTACTED", "ok")
    assert [(x.seq, x.reason) for x in rej.collect()] == [(1, C.REQUEST_NOT_FOUND)]


def test_patches_the_database_would_refuse(spark):
    t = H.teachers(spark, [{"id": 1, "subjects": "Old"}])
    p = spark.createDataFrame([
        (1, 1, {"profile_status": "RETIRED"}, AS_OF), (2, 1, {"full_name": None}, AS_OF),
        (3, 1, {"years_experience": "9x"}, AS_OF), (4, 1, {"will_move_sem1": "maybe"}, AS_OF),
        (5, 1, {"subjects": "New", "years_experience": "4"}, AS_OF),
    ], PATCH)
    new, rej = C.apply_teacher_patches(t, p)
    assert sorted(x.seq for x in rej.collect()) == [1, 2, 3, 4]
    row = new.first()
    assert (row.subjects, row.years_experience, row.profile_status) == ("New", 4, "ACTIVE")
    s = H.schools(spark, [{"id": 1, "email": "a@x.org"}])
    sp = spark.createDataFrame([(1, 1, {"name": None}, AS_OF), (2, 1, {"email": "b@x.org"}, AS_OF)], PATCH)
    new, rej = C.apply_school_patches(s, sp)
    assert [(x.seq, x.reason) for x in rej.collect()] == [(1, C.INVALID_VALUE)]
    assert new.first().email == "b@x.org"
    r = H.requests(spark, [{"id": 1, "teacher_id": 1, "school_id": 1}])
    ev = spark.createDataFrame([(1, "set_status", 1, None, None, "ARCHIVED", None, None)],
                               "seq long, kind string, request_id long, teacher_id long, school_id long, "
                               "status string, message string, admin_notes string")
    new, rej = C.apply_request_events(r, ev, as_of=AS_OF)
    assert new.first().status == "PENDING" and rej.first().reason == C.INVALID_STATUS


def test_unpaid_session_that_is_paid_later_activates(spark):
    s = H.schools(spark, [{"id": 1, "email": "a@x.org", "subscription_status": "NO_SUBSCRIPTION"}])
    ev = spark.createDataFrame([
        (1, "cs1", 1, "a@x.org", "BASIC", "unpaid", AS_OF), (2, "cs1", 1, "a@x.org", "BASIC", "paid", AS_OF),
        (3, "cs1", 1, "a@x.org", "PRO", "paid", AS_OF),
    ], "seq long, session_id string, school_id long, email string, plan string, payment_status string, ts timestamp_ntz")
    new, rej = C.activate_paid_plans(s, ev)
    row = new.first()
    assert (row.subscription_status, row.subscription_plan) == ("ACTIVE", "BASIC")
    assert {x.seq: x.reason for x in rej.collect()} == {1: C.PAYMENT_INCOMPLETE, 3: C.DUPLICATE_SESSION}


def test_created_requests_need_known_keys_and_a_free_id(spark):
    r = H.requests(spark, [{"id": 1, "teacher_id": 1, "school_id": 1}])
    ev = spark.createDataFrame([
        (1, "create", 50, 999, 1, None, "x", None), (2, "create", 50, 1, 888, None, "x", None),
        (3, "create", 50, 1, 1, None, "first", None), (4, "create", 50, 1, 1, None, "again", None),
        (5, "create", 1, 1, 1, None, "taken", None), (6, "set_status", 50, None, None, "CLOSED", None, None),
    ], "seq long, kind string, request_id long, teacher_id long, school_id long, status string, message string, "
       "admin_notes string")
    new, rej = C.apply_request_events(r, ev, AS_OF, H.teachers(spark, [{"id": 1}]), H.schools(spark, [{"id": 1}]))
    got = {x.id: (x.status, x.school_message) for x in new.collect()}
    assert len(got) == new.count() == 2 and got[50] == ("CLOSED", "first")
    assert {x.seq: x.reason for x in rej.collect()} == {
        1: C.TEACHER_NOT_FOUND, 2: C.SCHOOL_NOT_FOUND, 4: C.DUPLICATE_REQUEST, 5: C.DUPLICATE_REQUEST}


def test_updated_at_is_the_time_of_the_last_patch_by_seq(spark):
    t = H.teachers(spark, [{"id": 1}])
    late, early = AS_OF + dt.timedelta(days=5), AS_OF + dt.timedelta(days=3)
    new, _ = C.apply_teacher_patches(t, spark.createDataFrame(
        [(1, 1, {"bio": "a"}, late), (2, 1, {"bio": "b"}, early)], PATCH))
    assert (new.first().bio, new.first().updated_at) == ("b", early)


def test_patch_texts_become_the_types_of_their_columns(spark):
    t = H.teachers(spark, [{"id": 1, "years_experience": 3, "is_visible_in_school_portal": False}, {"id": 2, "phone": "1"}])
    p = spark.createDataFrame([
        (1, 1, {"will_move_sem1": " TRUE ", "will_move_sem2": "true", "is_visible_in_school_portal": "true"}, AS_OF),
        (2, 1, {"will_move_sem2": "False", "years_experience": None, "phone": "007"}, AS_OF),
        (3, 2, {"years_experience": "12", "phone": None}, AS_OF),
    ], PATCH)
    new, rej = C.apply_teacher_patches(t, p)
    assert rej.count() == 0 and new.dtypes == t.dtypes
    assert {x.id: (x.will_move_sem1, x.will_move_sem2, x.is_visible_in_school_portal, x.years_experience, x.phone)
            for x in new.collect()} == {1: (True, False, True, None, "007"), 2: (False, False, True, 12, None)}


def test_every_patch_is_applied_or_rejected_once(spark):
    t = H.teachers(spark, [{"id": 1}, {"id": 2}])
    p = spark.createDataFrame([
        (1, 1, {"bio": "b"}, AS_OF), (2, 9, {"bio": "b"}, AS_OF), (3, None, {"bio": "b"}, AS_OF),
        (4, 2, {"is_visible_in_school_portal": "perhaps", "bio": "b"}, AS_OF), (5, 2, {}, AS_OF),
        (6, 9, {"full_name": None}, AS_OF), (7, 2, {"email": None}, AS_OF),
    ], PATCH)
    new, rej = C.apply_teacher_patches(t, p)
    assert rej.columns == ["seq", "key", "reason"]
    assert sorted(map(tuple, rej.collect())) == [
        (2, "9", C.TEACHER_NOT_FOUND), (3, None, C.TEACHER_NOT_FOUND), (4, "2", C.INVALID_VALUE),
        (6, "9", C.TEACHER_NOT_FOUND), (7, "2", C.INVALID_VALUE)]
    assert {x.id: x.bio for x in new.collect()} == {1: "b", 2: None}


def test_region_list_follows_the_patches(spark):
    t = H.teachers(spark, [{"id": i, "current_region": r} for i, r in
                           ((1, None), (2, "Region 3"), (3, "Region 3"), (4, None), (5, "Region 3"), (6, None))])
    p = spark.createDataFrame([
        (1, 1, {"current_region": "Region 3", "years_experience": "5"}, AS_OF),
        (2, 2, {"current_region": "Region 4"}, AS_OF), (3, 3, {"is_visible_in_school_portal": "false"}, AS_OF),
        (4, 4, {"current_region": "Region 3"}, AS_OF), (5, 4, {"current_region": None}, AS_OF),
        (6, 6, {"current_region": "Region 3", "profile_status": "RETIRED"}, AS_OF),
    ], PATCH)
    out = D.portal_teacher_list(C.apply_teacher_patches(t, p)[0], region="Region 3")
    assert out.columns == D.PORTAL_LIST_COLUMNS
    assert sorted((x.id, x.years_experience) for x in out.collect()) == [(1, 5), (5, None)]

"""Batch redemption (M5) and registration with codes (M6) against sequential models."""

import random

from pyspark.sql import functions as F

from chalkline.operators import changes as C
from chalkline.operators import redeem as RD
from tests import helpers as H

ATT = "seq long, school_id long, code string"


def _run(spark, schools, codes, attempts):
    s = H.schools(spark, schools)
    c = H.codes(spark, codes)
    a = spark.createDataFrame([(x["seq"], x["school_id"], x["code"]) for x in attempts], ATT)
    out, ns, nc = RD.redeem_access_codes(s, c, a, as_of=H.AS_OF)
    return {x.seq: x.reason for x in out.collect()}, ns, nc


def sequential_redeem(schools: list[dict], codes: list[dict], attempts: list[dict]) -> dict:
    """Plain sequential model of M5 for tests: seq -> reason (None = accepted)."""
    sch = {s["id"]: dict(s) for s in schools}
    by_code = {c["code"]: dict(c) for c in codes}
    holders = {c["school_id"] for c in codes if c.get("school_id") is not None}
    out = {}
    for a in sorted(attempts, key=lambda x: x["seq"]):
        code, sid = a.get("code"), a["school_id"]
        if not code:
            out[a["seq"]] = RD.MSG_CODE_REQUIRED
            continue
        s = sch.get(sid)
        if s is None:
            out[a["seq"]] = RD.MSG_SCHOOL_NOT_FOUND
            continue
        if not (s["subscription_status"] == "NO_SUBSCRIPTION" and s.get("subscription_plan") is None
                and s.get("subscription_end_at") is None):
            out[a["seq"]] = RD.MSG_PAID
            continue
        c = by_code.get(code)
        if c is None:
            out[a["seq"]] = RD.MSG_INVALID_CODE
            continue
        if sid in holders:
            out[a["seq"]] = RD.MSG_TRIAL_USED
            continue
        if c["status"] != "UNUSED":
            out[a["seq"]] = RD.MSG_CODE_USED
            continue
        c["status"], c["school_id"] = "ACTIVE", sid
        holders.add(sid)
        s["subscription_status"], s["subscription_end_at"] = "TRIAL", "set"
        out[a["seq"]] = None
    return out


def test_second_attempt_on_a_code_can_win(spark):
    schools = [{"id": 1}, {"id": 2}]
    codes = [{"code": "c1"}, {"code": "c2"}]
    attempts = [{"seq": 1, "school_id": 1, "code": "c1"}, {"seq": 2, "school_id": 1, "code": "c2"},
                {"seq": 3, "school_id": 2, "code": "c2"}]
    got, ns, nc = _run(spark, schools, codes, attempts)
    assert got == {1: None, 2: RD.MSG_PAID, 3: None}
    assert {x.id: x.subscription_status for x in ns.collect()} == {1: "TRIAL", 2: "TRIAL"}
    assert {x.code: (x.status, x.school_id) for x in nc.collect()} == {"c1": ("ACTIVE", 1), "c2": ("ACTIVE", 2)}


def test_static_reasons(spark):
    schools = [{"id": 1}, {"id": 2, "subscription_status": "ACTIVE"}, {"id": 3}]
    codes = [{"code": "used", "status": "ACTIVE"}, {"code": "held", "school_id": 3, "status": "EXPIRED"},
             {"code": "free"}]
    attempts = [{"seq": 1, "school_id": 2, "code": "free"}, {"seq": 2, "school_id": 1, "code": "nope"},
                {"seq": 3, "school_id": 3, "code": "free"}, {"seq": 4, "school_id": 1, "code": "used"},
                {"seq": 5, "school_id": 1, "code": ""}, {"seq": 6, "school_id": 42, "code": "free"}]
    got, _, _ = _run(spark, schools, codes, attempts)
    assert got == {1: RD.MSG_PAID, 2: RD.MSG_INVALID_CODE, 3: RD.MSG_TRIAL_USED, 4: RD.MSG_CODE_USED,
                   5: RD.MSG_CODE_REQUIRED, 6: RD.MSG_SCHOOL_NOT_FOUND}


def test_long_conflict_chain(spark):
    # s1->c1, s1->c2, s2->c2, s2->c3, s3->c3 ... alternating conflicts
    n = 12
    schools = [{"id": i} for i in range(1, n + 1)]
    codes = [{"code": f"c{i}"} for i in range(1, n + 2)]
    attempts, seq = [], 0
    for i in range(1, n + 1):
        for cd in (f"c{i}", f"c{i + 1}"):
            seq += 1
            attempts.append({"seq": seq, "school_id": i, "code": cd})
    got, _, _ = _run(spark, schools, codes, attempts)
    assert got == sequential_redeem(schools_full(schools), codes_full(codes), attempts)


def test_chain_of_2000_attempts_takes_logarithmic_steps(spark, monkeypatch):
    rng, steps = random.Random(3), []
    stored = RD._stored
    monkeypatch.setattr(RD, "_stored", lambda df, path: steps.append(path) or stored(df, path))
    chain = [(s, s // 2, f"c{(s + 1) // 2}") for s in range(2000)]           # each attempt hangs on the one before
    hung = [(2000 + s, s, f"c{2000 + rng.randrange(40)}") for s in range(0, 1000, 7)]   # and others on parts of it
    rows = chain + hung
    schools, codes, want = set(), set(), []
    for seq, school, code in rows:
        if school not in schools and code not in codes:
            schools.add(school)
            codes.add(code)
            want.append(seq)
    df = spark.createDataFrame(rows, "seq long, school_id long, code string")
    got = RD.greedy_match(df, "school_id", "code")
    assert sorted(r.seq for r in got.collect()) == want
    hops = [p for p in steps if "/answers=0/hop=" in p]
    assert len(hops) <= 13 and len([p for p in steps if "/won/" in p]) <= 3 and len(steps) <= 25


def test_shuffled_chains_and_null_keys(spark):
    rng = random.Random(5)
    for _ in range(3):
        seqs = rng.sample(range(1000), 150)
        rows = [(q, rng.randrange(30), None if rng.random() < .1 else f"c{rng.randrange(30)}") for q in seqs]
        schools, codes, want = set(), set(), []
        for seq, school, code in sorted(rows, key=lambda r: r[0]):
            if school not in schools and (code is None or code not in codes):
                schools.add(school)
                codes.add(code)
                want.append(seq)
        df = spark.createDataFrame(rows, "seq long, school_id long, code string")
        assert sorted(r.seq for r in RD.greedy_match(df, "school_id", "code").collect()) == want


def test_no_candidates(spark):
    assert RD.greedy_match(spark.createDataFrame([], "seq long, school_id long, code string"), "school_id", "code").count() == 0


def schools_full(rows):
    return [dict({"subscription_status": "NO_SUBSCRIPTION", "subscription_plan": None,
                  "subscription_end_at": None}, **r) for r in rows]


def codes_full(rows):
    return [dict({"status": "UNUSED", "school_id": None}, **r) for r in rows]


def test_random_batches_match_sequential_model(spark):
    rng = random.Random(7)
    for _ in range(3):
        schools = [{"id": i, "subscription_status": rng.choice(["NO_SUBSCRIPTION"] * 4 + ["TRIAL"])}
                   for i in range(1, 25)]
        codes = [{"code": f"c{i}", "status": rng.choice(["UNUSED"] * 4 + ["ACTIVE"]),
                  "school_id": rng.choice([None] * 9 + [rng.randint(1, 24)])} for i in range(1, 30)]
        attempts = [{"seq": s, "school_id": rng.randint(1, 26), "code": f"c{rng.randint(1, 32)}"}
                    for s in rng.sample(range(1000), 120)]
        got, _, _ = _run(spark, schools, codes, attempts)
        assert got == sequential_redeem(schools_full(schools), codes_full(codes), attempts)


def test_register_with_codes_matches_sequential(spark):
    s = H.schools(spark, [{"id": 5, "email": "old@x.org"}])
    c = H.codes(spark, [{"code": "k1"}, {"code": "k2"}, {"code": "k3", "status": "ACTIVE"}])
    rows = [(1, "A", "c", "a@x.org", "k1"), (2, "B", "c", "b@x.org", "k1"),   # k1 consumed by seq 1
            (3, "B", "c", "b@x.org", "k2"),                                    # b@ free again: wins k2
            (4, "C", "c", "a@x.org", None),                                    # a@ taken by seq 1
            (5, "D", "c", "d@x.org", "k3"),                                    # code not unused
            (6, "E", "c", "e@x.org", None)]
    sign = (spark.createDataFrame(rows, "seq long, name string, contact_name string, email string, access_code string")
            .withColumn("country", F.lit(None).cast("string")).withColumn("region", F.lit(None).cast("string")))
    ins, rej, nc = C.register_schools(s, sign, c, as_of=H.AS_OF)
    assert {x.email: x.subscription_status for x in ins.collect()} == {
        "a@x.org": "TRIAL", "b@x.org": "TRIAL", "e@x.org": "NO_SUBSCRIPTION"}
    assert {x.seq: x.reason for x in rej.collect()} == {
        2: C.CODE_INVALID_OR_USED, 4: C.EMAIL_TAKEN, 5: C.CODE_INVALID_OR_USED}
    assert {x.code: x.school_id for x in nc.collect()} == {"k1": 7, "k2": 9, "k3": None}


def test_hot_school_and_hot_code(spark):
    # one school makes a third of all attempts and one code gets a third of them
    rng = random.Random(11)
    schools = [{"id": i} for i in range(1, 41)]
    codes = [{"code": f"c{i}"} for i in range(1, 41)]
    attempts = []
    for s in range(300):
        sid = 1 if s % 3 == 0 else rng.randint(2, 40)
        code = "c1" if s % 3 == 1 else f"c{rng.randint(1, 40)}"
        attempts.append({"seq": s, "school_id": sid, "code": code})
    got, _, _ = _run(spark, schools, codes, attempts)
    assert got == sequential_redeem(schools_full(schools), codes_full(codes), attempts)


def test_fixture_outcomes_match_recorded_counts(spark):
    # FIXTURES.md §2.2: sf0.01 -> 14 succeed; 1641 ineligible, 288 unknown code, 43 trial used, 20 code used
    from chalkline.plans.catalog import Fixture
    from chalkline.sources import fixtures as fx
    d = "/root/testdata/sf0.01"
    f = Fixture(spark, d)
    out, _, _ = RD.redeem_access_codes(f.schools, f.access_codes, fx.redeem_attempts(spark, d))
    got = {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()}
    assert got == {None: 14, RD.MSG_PAID: 1641, RD.MSG_INVALID_CODE: 288, RD.MSG_TRIAL_USED: 43,
                   RD.MSG_CODE_USED: 20}

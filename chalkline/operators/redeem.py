"""Batch access-code redemption (M5) and the matching engine it needs.

Sequential rule: attempts are processed in ``seq`` order; an attempt succeeds
when it passes the static checks and neither its school nor its code was
consumed by an earlier *successful* attempt. Two ``row_number() == 1``
filters are not enough (A->c1 ok, A->c2 fails, B->c2 must still succeed).

Parallel form with the same answer (``greedy_match``): an attempt's answer hangs
on the earlier undecided attempts that share a key with it. Each round
  1. accepts the attempts that are first for both of their keys;
  2. answers those with a single such earlier attempt: each wins where that one
     loses, so a chain of them alternates, and pointer doubling
     finds the start of each chain and the parity of the way to it;
  3. drops what shares a key with an accepted attempt.
The smallest undecided seq is always accepted, so the rounds end. A conflict
chain of n attempts takes about log2(n) doublings in one round. Attempts with
several undecided earlier ones wait for the next round; a batch in which these
hang on each other one by one still takes a round for each (such a walk is not
known to have a short parallel form).

Scale: the first and second seq of a key are ``groupBy().agg(min)`` (map-side
partial aggregation collapses a hot school or code before the shuffle), never a
window over a hot key; chains are joined on seq, which no row shares. Every
step is a written table below ``spark.checkpoint.dir``, so a lost executor
repeats tasks of one step; tables that later steps no longer need are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.time import hours
from chalkline.session import scratch_path
from chalkline.sources.tables import delete

# Redemption outcome messages, in check order.
MSG_CODE_REQUIRED = "Access code is required"
MSG_SCHOOL_NOT_FOUND = "School not found"
MSG_PAID = "You already use paid subscription"
MSG_INVALID_CODE = "Invalid access code"
MSG_TRIAL_USED = "You already used your trial access."
MSG_CODE_USED = "Code is already used. Please try a different code."

TRIAL_HOURS = 24


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again: the end of its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy_match(candidates: DataFrame, a: str, b: str) -> DataFrame:
    """Accepted rows of ``candidates`` (unique ``seq``) under sequential
    first-come matching on two keys. A null ``b`` conflicts with nothing.

    Only the first attempt of each (a, b) pair can ever win, so repeats are
    dropped up front.
    """
    spark = candidates.sparkSession
    folder = scratch_path(spark, "matching")
    undecided = _stored(candidates.groupBy(a, b).agg(F.min("seq").alias("seq")).select("seq", a, b), f"{folder}/open=0")
    n = 0
    while not undecided.isEmpty():
        answers = _answers(undecided, a, b, f"{folder}/answers={n}")
        won = _stored(undecided.join(answers.filter("won"), "seq", "left_semi"), f"{folder}/won/round={n}")
        n += 1
        undecided = _stored(undecided.join(answers, "seq", "left_anti")
                            .join(won.select(a).distinct(), a, "left_anti")
                            .join(won.select(b).distinct(), b, "left_anti"), f"{folder}/open={n}")
        delete(spark, f"{folder}/open={n - 1}", f"{folder}/answers={n - 1}")
    if n == 0:
        return candidates.select("seq", a, b).limit(0)
    return spark.read.schema(undecided.schema).option("basePath", f"{folder}/won").parquet(f"{folder}/won").select("seq", a, b)


def _answers(undecided: DataFrame, a: str, b: str, folder: str) -> DataFrame:
    """(seq, won) of the undecided attempts that hang on nothing, or on a chain of single earlier attempts."""
    keys = F.array(F.struct(F.lit("a").alias("of"), F.col(a).cast("string").alias("value")),
                   F.struct(F.lit("b").alias("of"), F.col(b).cast("string").alias("value")))
    one = F.struct("seq", F.when(F.col(b).isNull(), 1).otherwise(2).alias("n_keys")).alias("one")
    rows = undecided.select(F.explode(keys).alias("key"), one).filter("key.value IS NOT NULL")
    first = rows.groupBy("key").agg(F.min("one").alias("first"))
    second = (rows.join(first, "key").filter("one.seq > first.seq").groupBy("key")
              .agg(F.min("one").alias("second"), F.min("first.seq").alias("up")))
    places = (first.select("first.*", F.lit(None).cast("long").alias("up"))
              .unionByName(second.select("second.*", F.col("up").cast("long"))))
    # one row per attempt that is first or second for a key: all keys first, or one second and the others first
    nodes = (places.groupBy("seq", "n_keys").agg(F.count("*").alias("_places"), F.count("up").alias("_seconds"),
                                                 F.max("up").alias("up"))
             .filter("_places = n_keys AND _seconds <= 1")
             .select("seq", "up", F.lit(True).alias("won")))
    n, nodes = 0, _stored(nodes, f"{folder}/hop=0")
    while not nodes.filter("up IS NOT NULL").isEmpty():
        # won: the answer if the attempt at ``up`` loses (at the start of a chain: the answer)
        to = nodes.select(F.col("seq").alias("up"), F.col("up").alias("_up"), F.col("won").alias("_won"))
        hops = (nodes.filter("up IS NOT NULL").join(to, "up")     # no row for up: it hangs on several, so wait
                .select("seq", F.col("_up").alias("up"), (F.col("won") != F.col("_won")).alias("won")))
        nodes = _stored(nodes.filter("up IS NULL").unionByName(hops), f"{folder}/hop={n + 1}")
        delete(undecided.sparkSession, f"{folder}/hop={n}")
        n += 1
    return nodes.select("seq", "won")


def redeem_access_codes(schools: DataFrame, codes: DataFrame, attempts: DataFrame, as_of=None):
    """M5: apply a batch of redemption attempts (seq, school_id, code[, ts]).

    Returns ``(outcomes, new_schools, new_codes)``. ``outcomes`` has one row
    per attempt with ``accepted`` and ``reason`` (null when accepted). The
    attempt's ``ts`` (or ``as_of``) is its "now".
    """
    if "ts" not in attempts.columns:
        from chalkline.functions.time import ts_lit
        attempts = attempts.withColumn("ts", ts_lit(as_of))
    att = attempts.select("seq", "school_id", "code", "ts")

    sch = schools.select(
        F.col("id").alias("school_id"),
        ((F.col("subscription_status") == "NO_SUBSCRIPTION") & F.col("subscription_plan").isNull()
         & F.col("subscription_end_at").isNull()).alias("_eligible"))
    holders = (codes.filter(F.col("school_id").isNotNull()).select("school_id").distinct()
               .withColumn("_holds_code", F.lit(True)))
    code_state = (codes.groupBy("code")
                  .agg(F.max(F.when(F.col("status") == "UNUSED", 1).otherwise(0)).alias("_unused")))

    j = (att.join(sch, "school_id", "left").join(holders, "school_id", "left")
         .join(code_state, "code", "left"))
    no_code = F.col("code").isNull() | (F.col("code") == "")
    static_ok = (~no_code & F.col("_eligible") & F.col("_unused").isNotNull()
                 & F.col("_holds_code").isNull() & (F.col("_unused") == 1))
    j = j.withColumn("_static_ok", F.coalesce(static_ok, F.lit(False))).checkpoint(eager=True)

    won = greedy_match(j.filter("_static_ok").select("seq", "school_id", "code"), "school_id", "code")
    by_school = won.select("school_id", F.col("seq").alias("_school_won_seq"))
    by_code = won.select("code", F.col("seq").alias("_code_won_seq"))

    r = j.join(by_school, "school_id", "left").join(by_code, "code", "left")
    seq = F.col("seq")
    reason = (F.when(no_code, MSG_CODE_REQUIRED)
              .when(F.col("_eligible").isNull(), MSG_SCHOOL_NOT_FOUND)
              .when(~F.col("_eligible") | (F.col("_school_won_seq") < seq), MSG_PAID)
              .when(F.col("_unused").isNull(), MSG_INVALID_CODE)
              .when(F.col("_holds_code"), MSG_TRIAL_USED)
              .when((F.col("_unused") == 0) | (F.col("_code_won_seq") < seq), MSG_CODE_USED))
    outcomes = r.select("seq", "school_id", "code", "ts", reason.isNull().alias("accepted"),
                        reason.alias("reason"))

    ok = outcomes.filter("accepted").select("school_id", "code", "ts")
    new_schools = apply_trial(schools, ok)
    new_codes = activate_codes(codes, ok)
    return outcomes, new_schools, new_codes


def apply_trial(schools: DataFrame, ok: DataFrame) -> DataFrame:
    """Schools with an accepted redemption start a 24-hour trial at its time."""
    t = ok.select(F.col("school_id").alias("id"), F.col("ts").alias("_t"))
    j = schools.join(t, "id", "left")
    hit = F.col("_t").isNotNull()
    return j.select(*[
        (F.when(hit, F.lit("TRIAL")).otherwise(F.col(c)).alias(c) if c == "subscription_status"
         else F.when(hit, F.col("_t")).otherwise(F.col(c)).alias(c) if c == "subscription_started_at"
         else F.when(hit, F.col("_t") + hours(TRIAL_HOURS)).otherwise(F.col(c)).alias(c) if c == "subscription_end_at"
         else F.col(c))
        for c in schools.columns])


def activate_codes(codes: DataFrame, ok: DataFrame) -> DataFrame:
    """Codes used by an accepted redemption become ACTIVE for 24 hours, owned by the school."""
    t = ok.select("code", F.col("school_id").alias("_sid"), F.col("ts").alias("_t"))
    j = codes.join(t, "code", "left")
    hit = F.col("_t").isNotNull()
    repl = {
        "status": F.when(hit, F.lit("ACTIVE")).otherwise(F.col("status")),
        "school_id": F.when(hit, F.col("_sid")).otherwise(F.col("school_id")),
        "first_used_at": F.when(hit, F.col("_t")).otherwise(F.col("first_used_at")),
        "expires_at": F.when(hit, F.col("_t") + hours(TRIAL_HOURS)).otherwise(F.col("expires_at")),
    }
    return j.select(*[repl.get(c, F.col(c)).alias(c) for c in codes.columns])

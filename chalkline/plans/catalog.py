"""Registered queries: one callable per operator, run over the fixture binding.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from
the whole generated tables (no sampling, no row caps beyond a query's own
top-k). ``ORACLE`` holds the DuckDB statement of the same result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import SparkSession

from chalkline.operators import analytics as A
from chalkline.plans import oracle as O
from chalkline.session import scratch_path
from chalkline.sources import fixtures as fx
from chalkline.sources import tables as TB

AS_OF = fx.FIXTURE_AS_OF


class Fixture:
    """Domain tables bound to one scale-factor directory (lazy, cached per object)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def schools(self):
        return fx.schools(self.spark, self.sf_dir, AS_OF)

    @cached_property
    def teachers(self):
        return fx.teachers(self.spark, self.sf_dir, AS_OF)

    @cached_property
    def views(self):
        return fx.teacher_views(self.spark, self.sf_dir)

    @cached_property
    def requests(self):
        return fx.requests(self.spark, self.sf_dir)

    @cached_property
    def access_codes(self):
        return fx.access_codes(self.spark, self.sf_dir)

    @cached_property
    def redeem_attempts(self):
        return fx.redeem_attempts(self.spark, self.sf_dir)


def _former(df):
    """Those of a snapshot's rows that the former snapshot had."""
    return df.filter(f"created_at < TIMESTAMP_NTZ '{fx.FORMER_SNAPSHOT}'")


QUERIES = {}
ORACLE = {}


def register(name, oracle_sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


# ---- Q1-Q8: dashboards -------------------------------------------------------

for _tok, _days in [("7d", 7), ("24h", 1), ("30d", 30), ("90d", 90)]:
    _sfx = "" if _tok == "7d" else f"_{_tok}"

    register(f"period_totals{_sfx}", O.period_totals(_days))(
        lambda spark, d, t=_tok: A.period_totals(Fixture(spark, d).views, Fixture(spark, d).requests, AS_OF, t))
    register(f"daily_activity{_sfx}", O.daily_activity(_days))(
        lambda spark, d, t=_tok: (lambda f: A.daily_activity(f.views, f.requests, AS_OF, t))(Fixture(spark, d)))

# an unknown range token means 7 days
register("daily_activity_unknown_token", O.daily_activity(7))(
    lambda spark, d: (lambda f: A.daily_activity(f.views, f.requests, AS_OF, "1y"))(Fixture(spark, d)))

for _tok, _days in [("7d", 7), ("90d", 90)]:
    _sfx = "" if _tok == "7d" else f"_{_tok}"
    register(f"top_schools{_sfx}", O.top_schools(_days))(
        lambda spark, d, t=_tok: (lambda f: A.top_schools(f.views, f.schools, AS_OF, t))(Fixture(spark, d)))
    register(f"top_teachers{_sfx}", O.top_teachers(_days))(
        lambda spark, d, t=_tok: (lambda f: A.top_teachers(f.views, f.teachers, AS_OF, t))(Fixture(spark, d)))
    register(f"region_share{_sfx}", O.region_share(_days))(
        lambda spark, d, t=_tok: (lambda f: A.region_share(f.views, f.schools, AS_OF, t))(Fixture(spark, d)))


@register("dashboard_counts", O.DASHBOARD_COUNTS)
def _dashboard_counts(spark, d):
    f = Fixture(spark, d)
    return A.dashboard_counts(f.schools, f.teachers, f.requests)


@register("monthly_growth", O.MONTHLY_GROWTH)
def _monthly_growth(spark, d):
    f = Fixture(spark, d)
    return A.monthly_growth(f.teachers, f.schools, AS_OF)


@register("recent_requests", O.RECENT_REQUESTS)
def _recent_requests(spark, d):
    f = Fixture(spark, d)
    return A.recent_requests(f.requests, f.schools, f.teachers)


@register("recent_requests_by_day", O.RECENT_REQUESTS)
def _recent_requests_by_day(spark, d):
    f, base = Fixture(spark, d), scratch_path(spark, "requests-by-day")
    TB.write_snapshot(f.requests, base, "requests", 0, by_day=True)
    return A.recent_requests_by_day(TB.read_table(spark, base, "requests"), f.schools, f.teachers,
                                    TB.partition_days(spark, base, "requests"))


def _rolled(spark, d, answer):
    """``answer(views, fixture)`` over stored counts of all but the last two days, and the log for those."""
    from chalkline.sources import rollups as RU
    f, base = Fixture(spark, d), scratch_path(spark, "rollups")
    late = f"viewed_at > TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 2 DAYS"
    TB.append_views(f.views.filter(f"NOT ({late})"), f"{base}/teacher_views")
    RU.refresh(spark, base)
    TB.append_views(f.views.filter(late), f"{base}/teacher_views")
    return answer(RU.RolledViews(spark, base, AS_OF, "90d"), f)


from chalkline.operators import rolled as RO  # noqa: E402

register("period_totals_rolled_90d", O.period_totals(90))(
    lambda spark, d: _rolled(spark, d, lambda v, f: RO.period_totals(v, f.requests, AS_OF, "90d")))
register("daily_activity_rolled_90d", O.daily_activity(90))(
    lambda spark, d: _rolled(spark, d, lambda v, f: RO.daily_activity(v, f.requests, AS_OF, "90d")))
register("top_schools_rolled_90d", O.top_schools(90))(
    lambda spark, d: _rolled(spark, d, lambda v, f: RO.top_schools(v, f.schools)))
register("top_teachers_rolled_90d", O.top_teachers(90))(
    lambda spark, d: _rolled(spark, d, lambda v, f: RO.top_teachers(v, f.teachers)))
register("region_share_rolled_90d", O.region_share(90))(
    lambda spark, d: _rolled(spark, d, lambda v, f: RO.region_share(v, f.schools)))


# ---- Q9-Q19: reports and rules -------------------------------------------------

from chalkline.operators import directory as D  # noqa: E402
from chalkline.operators import requests as R  # noqa: E402
from chalkline.operators import rules as U  # noqa: E402


@register("request_search", O.REQUEST_SEARCH)
def _request_search(spark, d):
    f = Fixture(spark, d)
    return R.request_search(f.requests, f.teachers, f.schools)


@register("request_search_pending", O.REQUEST_SEARCH_PENDING)
def _request_search_pending(spark, d):
    f = Fixture(spark, d)
    return R.request_search(f.requests, f.teachers, f.schools, status="PENDING")


@register("request_search_text", O.REQUEST_SEARCH_TEXT)
def _request_search_text(spark, d):
    f = Fixture(spark, d)
    return R.request_search(f.requests, f.teachers, f.schools, search="customer#00000001")


@register("request_detail", O.REQUEST_DETAIL)
def _request_detail(spark, d):
    f = Fixture(spark, d)
    return R.request_search(f.requests, f.teachers, f.schools, detail=True)


@register("school_request_feed", O.SCHOOL_REQUEST_FEED)
def _school_request_feed(spark, d):
    f = Fixture(spark, d)
    return R.flatten_struct(R.school_request_feed(f.requests, f.teachers), "teacher")


@register("school_request_detail", O.SCHOOL_REQUEST_DETAIL)
def _school_request_detail(spark, d):
    f = Fixture(spark, d)
    return R.flatten_struct(R.school_request_feed(f.requests, f.teachers, detail=True), "teacher")


@register("portal_teacher_list", O.PORTAL_TEACHER_LIST)
def _portal_teacher_list(spark, d):
    return D.portal_teacher_list(Fixture(spark, d).teachers, seed=7)


@register("portal_teacher_detail", O.PORTAL_TEACHER_DETAIL)
def _portal_teacher_detail(spark, d):
    return D.portal_teacher_list(Fixture(spark, d).teachers, detail=True)


@register("portal_teacher_subject", O.PORTAL_TEACHER_SUBJECT)
def _portal_teacher_subject(spark, d):
    return D.portal_teacher_list(Fixture(spark, d).teachers, subjects="RING")


@register("teacher_export", O.TEACHER_EXPORT)
def _teacher_export(spark, d):
    return D.teacher_export(Fixture(spark, d).teachers)


@register("school_export", O.SCHOOL_EXPORT)
def _school_export(spark, d):
    return D.school_export(Fixture(spark, d).schools)


@register("access_code_report", O.ACCESS_CODE_REPORT)
def _access_code_report(spark, d):
    f = Fixture(spark, d)
    return D.access_code_report(f.access_codes, f.schools)


@register("subscription_status_report", O.SUBSCRIPTION_STATUS_REPORT)
def _subscription_status_report(spark, d):
    return U.subscription_status_report(Fixture(spark, d).schools)


@register("plan_change_check", O.PLAN_CHANGE_CHECK)
def _plan_change_check(spark, d):
    return U.plan_change_check(Fixture(spark, d).schools, fx.plan_wants(spark, d), AS_OF)


@register("entitlement_report", O.ENTITLEMENT_REPORT)
def _entitlement_report(spark, d):
    return U.entitlement_report(Fixture(spark, d).schools, AS_OF)


@register("access_code_check", O.ACCESS_CODE_CHECK)
def _access_code_check(spark, d):
    f = Fixture(spark, d)
    return U.access_code_check(f.redeem_attempts, f.access_codes)


@register("constraint_report", O.CONSTRAINT_REPORT)
def _constraint_report(spark, d):
    f = Fixture(spark, d)
    return U.constraint_report(f.schools, f.teachers, f.access_codes, f.requests, f.views)


@register("constraint_report_restored", O.CONSTRAINT_REPORT_RESTORED)
def _constraint_report_restored(spark, d):
    f = Fixture(spark, d)
    schools = fx.restored_twice(_former(f.schools), "subscription_status", "subscription_plan")
    teachers = fx.restored_twice(_former(f.teachers), "profile_status")
    codes = f.access_codes.unionByName(fx.lower_cased(f.access_codes, "status"))
    return U.constraint_report(schools, teachers, codes, f.requests, f.views)


@register("view_log", O.VIEW_LOG)
def _view_log(spark, d):
    return U.view_log(Fixture(spark, d).views)


# ---- M1-M11, I1: change-feed jobs --------------------------------------------------

from chalkline.operators import changes as C  # noqa: E402
from chalkline.operators import ingest as I  # noqa: E402
from chalkline.operators import redeem as RD  # noqa: E402
from chalkline.plans import oracle_changes as OC  # noqa: E402


def _flat_union(parts: dict):
    """One-row summary of several DataFrame counts without a cross join."""
    from pyspark.sql import functions as F
    tagged = None
    for name, df in parts.items():
        t = df.select(F.lit(name).alias("_t"))
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.agg(*[F.count_if(F.col("_t") == n).alias(n) for n in parts])


@register("expire_subscriptions", OC.EXPIRE_SUBSCRIPTIONS)
def _expire(spark, d):
    return C.expire_subscriptions(Fixture(spark, d).schools, AS_OF)


def _archive(spark, d):
    f = Fixture(spark, d)
    return C.archive_teachers(f.teachers, f.requests, f.views, fx.delete_ids(spark, d))


register("archive_teachers", OC.ARCHIVE_TEACHERS)(lambda spark, d: _archive(spark, d)[0])
register("archive_teachers_rejects", OC.ARCHIVE_TEACHERS_REJECTS)(lambda spark, d: _archive(spark, d)[4])
register("archive_cascade_counts", OC.ARCHIVE_CASCADE_COUNTS)(
    lambda spark, d: (lambda a: _flat_union({"teachers_left": a[1], "requests_left": a[2], "views_left": a[3]}))(
        _archive(spark, d)))


for _k, _name, _sql in ((1, "teachers", OC.ARCHIVE_TEACHERS_LEFT), (2, "requests", OC.ARCHIVE_REQUESTS_LEFT),
                        (3, "views", OC.ARCHIVE_VIEWS_LEFT)):
    register(f"archive_{_name}_left", _sql)(lambda spark, d, k=_k: _archive(spark, d)[k])
register("archived_teacher_export", OC.ARCHIVE_TEACHERS)(lambda spark, d: D.archived_teacher_export(_archive(spark, d)[0]))


def _tpatch(spark, d):
    return C.apply_teacher_patches(Fixture(spark, d).teachers, fx.teacher_patches(spark, d))


register("apply_teacher_patches", OC.APPLY_TEACHER_PATCHES)(lambda spark, d: _tpatch(spark, d)[0])
register("apply_teacher_patches_rejects", OC.APPLY_TEACHER_PATCHES_REJECTS)(lambda spark, d: _tpatch(spark, d)[1])


register("portal_teacher_region", OC.PORTAL_TEACHER_REGION)(
    lambda spark, d: D.portal_teacher_list(_tpatch(spark, d)[0], region="Region 3"))


def _spatch(spark, d):
    return C.apply_school_patches(Fixture(spark, d).schools, fx.school_patches(spark, d))


register("apply_school_patches", OC.APPLY_SCHOOL_PATCHES)(lambda spark, d: _spatch(spark, d)[0])
register("apply_school_patches_rejects", OC.APPLY_SCHOOL_PATCHES_REJECTS)(lambda spark, d: _spatch(spark, d)[1])


def _paid(spark, d):
    return C.activate_paid_plans(Fixture(spark, d).schools, fx.checkout_events(spark, d))


register("activate_paid_plans", OC.ACTIVATE_PAID_PLANS)(lambda spark, d: _paid(spark, d)[0])
register("activate_paid_plans_rejects", OC.ACTIVATE_PAID_PLANS_REJECTS)(lambda spark, d: _paid(spark, d)[1])


def _override(spark, d):
    return C.override_subscription(Fixture(spark, d).schools, fx.subscription_overrides(spark, d))


register("override_subscription", OC.OVERRIDE_SUBSCRIPTION)(lambda spark, d: _override(spark, d)[0])
register("override_subscription_rejects", OC.OVERRIDE_SUBSCRIPTION_REJECTS)(lambda spark, d: _override(spark, d)[1])


def _cancel(spark, d):
    f = Fixture(spark, d)
    return C.cancel_subscriptions(f.schools, f.access_codes, fx.cancel_ids(spark, d))


register("cancel_subscriptions", OC.CANCEL_SUBSCRIPTIONS)(lambda spark, d: _cancel(spark, d)[0])
register("cancel_subscriptions_codes", OC.CANCEL_SUBSCRIPTIONS_CODES)(lambda spark, d: _cancel(spark, d)[1])
register("cancel_subscriptions_rejects", OC.CANCEL_SUBSCRIPTIONS_REJECTS)(lambda spark, d: _cancel(spark, d)[2])


def _reqev(spark, d):
    return C.apply_request_events(Fixture(spark, d).requests, fx.request_events(spark, d),
                                  teachers=Fixture(spark, d).teachers, schools=Fixture(spark, d).schools)


register("apply_request_events", OC.APPLY_REQUEST_EVENTS)(lambda spark, d: _reqev(spark, d)[0])


@register("apply_request_events_layered", OC.APPLY_REQUEST_EVENTS)
def _request_layers(spark, d):
    """The feed applied as a stored layer over a day-partitioned snapshot, read back merged."""
    from chalkline.plans import jobs
    from chalkline.sources import schemas as sch
    f, base = Fixture(spark, d), scratch_path(spark, "request-layers")
    for name in ("requests", "teachers", "schools"):
        TB.write_snapshot(getattr(f, name), base, name, 1, by_day=name == "requests")
    jobs.apply_request_events(spark, base, fx.request_events(spark, d), AS_OF)
    return TB.read_table(spark, base, "requests").select(*[c.name for c in sch.REQUESTS.fields])


register("apply_request_events_rejects", OC.APPLY_REQUEST_EVENTS_REJECTS)(lambda spark, d: _reqev(spark, d)[1])


def _codes(spark, d):
    return C.maintain_access_codes(Fixture(spark, d).access_codes, fx.code_ops(spark, d))


register("maintain_access_codes", OC.MAINTAIN_ACCESS_CODES)(lambda spark, d: _codes(spark, d)[0])
register("maintain_access_codes_rejects", OC.MAINTAIN_ACCESS_CODES_REJECTS)(lambda spark, d: _codes(spark, d)[1])


def _import(spark, d):
    return I.teacher_import(fx.teacher_sheet(spark, d), Fixture(spark, d).teachers, AS_OF)


register("teacher_import", OC.TEACHER_IMPORT)(lambda spark, d: _import(spark, d)[0])
register("teacher_import_rejects", OC.TEACHER_IMPORT_REJECTS)(lambda spark, d: _import(spark, d)[1])
register("teacher_import_summary", OC.TEACHER_IMPORT_SUMMARY)(lambda spark, d: _import(spark, d)[2])


def _import_files(spark, d):
    return I.teacher_import(I.read_sheet(spark, fx.teacher_sheet_files(spark, d)), Fixture(spark, d).teachers, AS_OF)


register("teacher_import_files", OC.TEACHER_IMPORT_FILES)(lambda spark, d: _import_files(spark, d)[0])
register("teacher_import_files_rejects", OC.TEACHER_IMPORT_FILES_REJECTS)(lambda spark, d: _import_files(spark, d)[1])


# Iterative matching: the Spark job runs parallel matching rounds; its oracle is
# an independent sequential walk (recursive CTE) in plans/oracle_changes.py.

def _register_schools(spark, d):
    f = Fixture(spark, d)
    return C.register_schools(f.schools, fx.signups(spark, d), f.access_codes)


register("register_schools", OC.REGISTER_SCHOOLS)(lambda spark, d: _register_schools(spark, d)[0])
register("register_schools_rejects", OC.REGISTER_SCHOOLS_REJECTS)(lambda spark, d: _register_schools(spark, d)[1])


register("register_schools_codes", OC.REGISTER_SCHOOLS_CODES)(lambda spark, d: _register_schools(spark, d)[2])


def _redeem(spark, d):
    f = Fixture(spark, d)
    return RD.redeem_access_codes(f.schools, f.access_codes, f.redeem_attempts)


register("redeem_access_codes", OC.REDEEM_ACCESS_CODES)(lambda spark, d: _redeem(spark, d)[0])
register("redeem_access_codes_schools", OC.REDEEM_ACCESS_CODES_SCHOOLS)(lambda spark, d: _redeem(spark, d)[1])
register("redeem_access_codes_codes", OC.REDEEM_ACCESS_CODES_CODES)(lambda spark, d: _redeem(spark, d)[2])


# ---- S1-S4: streams, run to the end of their input (availableNow) ------------------------

from chalkline.streaming import views as SV  # noqa: E402


def _ingested(spark, d):
    f = Fixture(spark, d)
    return SV.view_ingest(spark, SV.view_event_stream(spark, d), f.teachers, f.schools)


@register("view_ingest", O.VIEW_INGEST)
def _view_ingest(spark, d):
    return SV.read_ingested(spark, _ingested(spark, d)).drop("viewed_date")


@register("view_ingest_quarantine", O.VIEW_INGEST_QUARANTINE)
def _view_ingest_quarantine(spark, d):
    return SV.read_quarantine(spark, _ingested(spark, d))


# The stream meets the snapshots as they were fifty days before AS_OF; then the views held back are judged again by
# the present snapshots, of teachers and of schools one after the other.

def _ingested_early(spark, d):
    f = Fixture(spark, d)
    return SV.view_ingest(spark, SV.view_event_stream(spark, d), _former(f.teachers), _former(f.schools))


@register("view_ingest_early_quarantine", O.VIEW_INGEST_EARLY_QUARANTINE)
def _view_ingest_early_quarantine(spark, d):
    return SV.read_quarantine(spark, _ingested_early(spark, d))


@register("view_ingest_teachers_arrived", O.VIEW_INGEST_TEACHERS_ARRIVED)
def _view_ingest_teachers_arrived(spark, d):
    f, out = Fixture(spark, d), _ingested_early(spark, d)
    SV.rejudge_quarantine(spark, out, f.teachers, _former(f.schools))
    return SV.read_quarantine(spark, out)


@register("view_ingest_all_arrived", O.VIEW_INGEST)
def _view_ingest_all_arrived(spark, d):
    f, out = Fixture(spark, d), _ingested_early(spark, d)
    SV.rejudge_quarantine(spark, out, f.teachers, _former(f.schools))
    SV.rejudge_quarantine(spark, out, f.teachers, f.schools)
    return SV.read_ingested(spark, out).drop("viewed_date")


@register("live_daily_counts", O.LIVE_DAILY_COUNTS)
def _live_daily_counts(spark, d):
    return SV.read_daily_counts(spark, SV.live_daily_counts(
        spark, SV.view_event_stream(spark, d), requests=SV.request_event_stream(spark, d)), requests=True)


@register("live_daily_counts_closed", O.LIVE_DAILY_COUNTS_CLOSED)
def _live_daily_counts_closed(spark, d):
    return SV.read_daily_counts(spark, SV.live_daily_counts(
        spark, SV.view_event_stream(spark, d), mode="append", requests=SV.request_event_stream(spark, d)), requests=True)


@register("live_top_schools", O.LIVE_TOP_SCHOOLS)
def _live_top_schools(spark, d):
    return SV.read_top_schools(spark, SV.live_top_schools(spark, SV.view_event_stream(spark, d), Fixture(spark, d).schools))


@register("live_active_schools", O.LIVE_ACTIVE_SCHOOLS)
def _live_active_schools(spark, d):
    return SV.read_active_schools(spark, SV.live_active_schools(spark, SV.view_event_stream(spark, d)))


# ---- dashboards over the larger line-item view log (FIXTURES §2.3) ------------------------

LI_AS_OF = fx.LINEITEM_AS_OF


def _li(spark, d):
    return fx.lineitem_views(spark, d), fx.lineitem_requests(spark, d)


register("period_totals_lineitem", O.period_totals(7, "li_views", "li_requests", O.LI_AS_OF))(
    lambda spark, d: A.period_totals(*_li(spark, d), LI_AS_OF, "7d"))
register("daily_activity_lineitem_90d", O.daily_activity(90, "li_views", "li_requests", O.LI_AS_OF))(
    lambda spark, d: A.daily_activity(*_li(spark, d), LI_AS_OF, "90d"))
register("top_schools_lineitem_90d", O.top_schools(90, "li_views", O.LI_AS_OF))(
    lambda spark, d: A.top_schools(fx.lineitem_views(spark, d), Fixture(spark, d).schools, LI_AS_OF, "90d"))
register("top_teachers_lineitem_all", O.top_teachers(None, "li_views", O.LI_AS_OF))(
    lambda spark, d: A.top_teachers(fx.lineitem_views(spark, d), Fixture(spark, d).teachers, LI_AS_OF, A.ALL_TIME))
register("region_share_lineitem_all", O.region_share(None, "li_views", O.LI_AS_OF))(
    lambda spark, d: A.region_share(fx.lineitem_views(spark, d), Fixture(spark, d).schools, LI_AS_OF, A.ALL_TIME))

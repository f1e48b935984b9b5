"""The dashboard bundle and the invariants of SURVEY §5.4."""

import __spark_entry__ as E
from chalkline.operators import analytics as A
from chalkline.operators import changes as C
from chalkline.plans.catalog import AS_OF, Fixture
from chalkline.plans.dashboard import AdminDashboard
from chalkline.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_bundle_equals_single_queries(spark):
    f = Fixture(spark, SF)
    d = AdminDashboard(f.views, f.requests, f.schools, f.teachers, AS_OF, "30d")
    try:
        q = E.queries()
        assert _rows(d.totals) == _rows(q["period_totals_30d"](spark, SF))
        assert _rows(d.chart) == _rows(q["daily_activity_30d"](spark, SF))
        assert _rows(d.top_schools) == _rows(A.top_schools(f.views, f.schools, AS_OF, "30d"))
        assert _rows(d.regions) == _rows(A.region_share(f.views, f.schools, AS_OF, "30d"))
    finally:
        d.release()


def test_chart_sums_to_totals_without_future_rows(spark):
    f = Fixture(spark, SF)
    for tok in ("24h", "7d", "90d"):
        total = A.period_totals(f.views, f.requests, AS_OF, tok).first()
        chart = A.daily_activity(f.views, f.requests, AS_OF, tok).collect()
        assert sum(r.views for r in chart) == total.views
        assert sum(r.requests for r in chart) == total.requests


def test_approximate_active_schools_close(spark):
    f = Fixture(spark, SF)
    exact = A.period_totals(f.views, f.requests, AS_OF, "90d").first().active_schools
    approx = A.period_totals(f.views, f.requests, AS_OF, "90d", approximate=True).first().active_schools
    assert abs(approx - exact) <= 0.1 * exact


def test_feed_rows_are_accepted_or_rejected(spark):
    f = Fixture(spark, SF)
    # M8: every override is either rejected or applied to an existing school
    feed = fx.subscription_overrides(spark, SF)
    _, rej = C.override_subscription(f.schools, feed)
    applied = feed.join(rej.select("seq"), "seq", "left_anti")
    assert applied.join(f.schools.select(f.schools.id.alias("school_id")), "school_id", "left_anti").count() == 0
    assert applied.count() + rej.count() == feed.count()
    # M10: the new snapshot holds the old requests plus every create that is not rejected
    feed = fx.request_events(spark, SF)
    new, rej = C.apply_request_events(f.requests, feed)
    creates = feed.filter("kind = 'create'")
    refused = creates.join(rej.select("seq"), "seq", "left_semi").count()
    assert refused > 0 and new.count() == f.requests.count() + creates.count() - refused


def test_expire_twice_is_idempotent_on_fixture(spark):
    f = Fixture(spark, SF)
    once = C.expire_subscriptions(f.schools, AS_OF)
    assert once.exceptAll(C.expire_subscriptions(once, AS_OF)).count() == 0

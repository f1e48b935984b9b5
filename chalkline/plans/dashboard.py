"""The admin dashboard (Q1-Q5) as one unit: one as_of, one filtered view of each fact.

The reference sends five statements on separate connections, each with its
own ``NOW()``, so totals and chart can disagree under load. Here the two
facts are filtered once (predicate pushed to the scan), persisted, and the
five outputs are derived from the same persisted rows: one scan per fact
for the whole dashboard, and all five answers agree.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from chalkline.operators import analytics as A
from chalkline.operators import rolled as RO
from chalkline.sources.rollups import RolledViews

# The five outputs of the dashboard, in response order.
_OUTPUTS = ("totals", "chart", "top_schools", "top_teachers", "regions")


class AdminDashboard:
    """Lazy outputs over persisted, window-filtered facts; call ``release()`` when done."""

    def __init__(self, views: DataFrame, requests: DataFrame, schools: DataFrame, teachers: DataFrame,
                 as_of, range_token: str = "7d", n: int = 5):
        self.views = (A.recent_views(views, as_of, range_token)
                      .select("id", "teacher_id", "school_id", "viewed_at")
                      .persist(StorageLevel.MEMORY_AND_DISK))
        self.requests = (A.recent_requests_in(requests, as_of, range_token)
                         .select("requested_at").persist(StorageLevel.MEMORY_AND_DISK))
        # the persisted rows already satisfy the window; the operators re-apply the
        # same predicate, which is a no-op filter on them
        self.totals = A.period_totals(self.views, self.requests, as_of, range_token)
        self.chart = A.daily_activity(self.views, self.requests, as_of, range_token)
        self.top_schools = A.top_schools(self.views, schools, as_of, range_token, n)
        self.top_teachers = A.top_teachers(self.views, teachers, as_of, range_token, n)
        self.regions = A.region_share(self.views, schools, as_of, range_token, n)

    def outputs(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in _OUTPUTS}

    def release(self) -> None:
        self.views.unpersist()
        self.requests.unpersist()


class RolledDashboard:
    """The same outputs from stored daily counts; nothing is persisted, so ``release()`` has nothing to do."""

    def __init__(self, views: RolledViews, requests: DataFrame, schools: DataFrame, teachers: DataFrame,
                 as_of, range_token: str = "7d", n: int = 5):
        self._outputs = dict(zip(_OUTPUTS, (
            RO.period_totals(views, requests, as_of, range_token), RO.daily_activity(views, requests, as_of, range_token),
            RO.top_schools(views, schools, n), RO.top_teachers(views, teachers, n), RO.region_share(views, schools, n))))

    def outputs(self) -> dict[str, DataFrame]:
        return dict(self._outputs)

    def release(self) -> None:
        pass

"""The command line over a small warehouse built from the fixtures."""

import json

from chalkline.__main__ import main
from chalkline.plans.catalog import AS_OF, Fixture
from chalkline.sources import fixtures as fx
from chalkline.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _warehouse(spark, base):
    f = Fixture(spark, SF)
    for name, df in [("schools", f.schools), ("teachers", f.teachers), ("requests", f.requests),
                     ("access_codes", f.access_codes)]:
        TB.write_snapshot(df, base, name, 1)
    TB.append_views(f.views, f"{base}/teacher_views")


def test_cli_jobs(spark, tmp_path):
    base, out = str(tmp_path / "wh"), str(tmp_path / "out")
    _warehouse(spark, base)
    main(["dashboard", "--base", base, "--as-of", AS_OF, "--range", "30d", "--out", out], spark=spark)
    chart = spark.read.json(f"{out}/chartData")
    assert chart.count() == 31 and set(chart.columns) == {"date", "fullDate", "views", "requests"}
    stats = spark.read.json(f"{out}/stats").first()
    assert stats.totalViews == Fixture(spark, SF).views.count()
    r = main(["expire", "--base", base, "--as-of", AS_OF], spark=spark)
    assert r["version"] == 2
    att = str(tmp_path / "att")
    fx.redeem_attempts(spark, SF).write.parquet(att)
    r = main(["redeem", "--base", base, "--attempts", att, "--as-of", AS_OF], spark=spark)
    assert r == {"schools": 3, "access_codes": 2}
    assert json.dumps(r)


def test_cli_rolled_dashboard_and_compaction(spark, tmp_path):
    base = str(tmp_path / "wh")
    _warehouse(spark, base)
    feed = str(tmp_path / "feed")
    fx.request_events(spark, SF).write.parquet(feed)
    main(["requests", "--base", base, "--as-of", AS_OF, "--feed", feed, "--run-id", "e1"], spark=spark)
    days = main(["compact", "--base", base], spark=spark)
    assert days and all(not e["deltas"] for e in days.values())
    assert main(["rollup", "--base", base], spark=spark)["n"] == 0
    found = {}
    for how in ([], ["--rolled"]):
        out = str(tmp_path / f"out{len(how)}")
        main(["dashboard", "--base", base, "--as-of", AS_OF, "--range", "30d", "--out", out, *how], spark=spark)
        found[len(how)] = {k: sorted(map(str, spark.read.json(f"{out}/{k}").collect()))
                           for k in ("stats", "chartData", "topSchools", "topTeachers", "regionData")}
    assert found[0] == found[1]

"""Command line for scheduled runs (``spark-submit --py-files chalkline.zip chalkline/__main__.py ...``
or ``python -m chalkline ...``).

Tables live in a warehouse folder written by ``chalkline.sources.tables``:
``<base>/<table>/v=<n>`` snapshots and a day-partitioned ``<base>/teacher_views``.

    python -m chalkline dashboard --base WH --as-of "2024-01-31 00:00:00" --range 7d --out OUT
    python -m chalkline expire    --base WH --as-of "2024-01-31 00:00:00"
    python -m chalkline redeem    --base WH --attempts PATH --as-of "2024-01-31 00:00:00"
    python -m chalkline archive   --base WH --feed PATH --as-of "..." --run-id 2024-01-31   (also register, cancel,
                                  override, requests, codes)

A run id that is published already changes nothing, so a scheduler may repeat a command.
"""

from __future__ import annotations

import argparse
import json


def _session():
    from pyspark import SparkConf

    from chalkline.session import build_session, cluster_session
    local = SparkConf().get("spark.master", "local[*]").startswith("local")
    return build_session() if local else cluster_session()


def cmd_dashboard(spark, a) -> dict:
    from chalkline.plans.dashboard import AdminDashboard, RolledDashboard
    from chalkline.plans.responses import to_response, write_json
    from chalkline.sources import tables as TB
    from chalkline.plans.jobs import live_views
    from chalkline.sources.rollups import RolledViews
    if a.rolled and a.tombstones:
        raise SystemExit("--rolled takes tombstones from the manifest; leave --tombstones out")
    views = (RolledViews(spark, a.base, a.as_of, a.range) if a.rolled
             else TB.read_live_views(spark, f"{a.base}/teacher_views", a.tombstones) if a.tombstones
             else live_views(spark, a.base))
    board = RolledDashboard if a.rolled else AdminDashboard
    d = board(views, TB.read_table(spark, a.base, "requests"), TB.read_table(spark, a.base, "schools"),
              TB.read_table(spark, a.base, "teachers"), a.as_of, a.range)
    kinds = {"totals": "stats", "chart": "chartData", "top_schools": "topSchools",
             "top_teachers": "topTeachers", "regions": "regionData"}
    try:
        for name, df in d.outputs().items():
            write_json(to_response(df, kinds[name]), f"{a.out}/{kinds[name]}")
    finally:
        d.release()
    return {"out": a.out}


def cmd_expire(spark, a) -> dict:
    from chalkline.plans.jobs import hourly_expiry
    return hourly_expiry(spark, a.base, a.as_of, a.run_id)


def cmd_redeem(spark, a) -> dict:
    from chalkline.plans.jobs import redeem_access_codes
    tables = redeem_access_codes(spark, a.base, spark.read.parquet(a.attempts), a.as_of, a.run_id)["tables"]
    return {t: tables[t] for t in ("schools", "access_codes")}


def cmd_rollup(spark, a) -> dict:
    from chalkline.plans.jobs import refresh_rollups
    return refresh_rollups(spark, a.base)


def cmd_compact(spark, a) -> dict:
    from chalkline.plans.jobs import compact_requests
    return compact_requests(spark, a.base, a.min_deltas)["layers"].get("requests", {})


def _feed_job(name: str):
    def run(spark, a) -> dict:
        from chalkline.plans import jobs
        return getattr(jobs, name)(spark, a.base, spark.read.parquet(a.feed), as_of=a.as_of, run_id=a.run_id)
    return run


#: Jobs that apply a feed file: command -> function of ``plans.jobs``.
FEED_JOBS = {"archive": "archive_teachers", "register": "register_schools", "cancel": "cancel_subscriptions",
             "override": "apply_overrides", "requests": "apply_request_events", "codes": "maintain_access_codes"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chalkline")
    sub = p.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("dashboard")
    d.add_argument("--base", required=True)
    d.add_argument("--as-of", required=True)
    d.add_argument("--range", default="7d")
    d.add_argument("--out", required=True)
    d.add_argument("--tombstones", default=None)
    d.add_argument("--rolled", action="store_true", help="read stored daily counts (command rollup) and the log for the rest")
    for name in ("rollup", "compact"):
        c = sub.add_parser(name)
        c.add_argument("--base", required=True)
    c.add_argument("--min-deltas", type=int, default=1)
    for name in ("expire", "redeem", *FEED_JOBS):
        c = sub.add_parser(name)
        c.add_argument("--base", required=True)
        c.add_argument("--as-of", required=True)
        c.add_argument("--run-id", default=None)
        if name == "redeem":
            c.add_argument("--attempts", required=True)
        elif name in FEED_JOBS:
            c.add_argument("--feed", required=True)
    return p


COMMANDS = {"dashboard": cmd_dashboard, "rollup": cmd_rollup, "compact": cmd_compact, "expire": cmd_expire, "redeem": cmd_redeem,
            **{name: _feed_job(job) for name, job in FEED_JOBS.items()}}


def main(argv=None, spark=None) -> dict:
    a = parser().parse_args(argv)
    result = COMMANDS[a.cmd](spark or _session(), a)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()

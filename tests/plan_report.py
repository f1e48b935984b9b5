"""Write PLANS.md: the planned shape of every registered query at a scale factor.

Usage: python tests/plan_report.py [/root/testdata/sf0.1]
"""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STREAMS = ("view_ingest", "live_")


def main():
    from chalkline.plans.inspect import plan_summary
    from chalkline.session import build_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for name, fn in sorted(E.queries().items()):
        if name.startswith(STREAMS):
            continue          # their result DataFrame is a read of the stream's sink
        s = plan_summary(fn(spark, sf))
        rows.append((name, s))
    lines = [
        "# Planned physical shape of the registered queries",
        "",
        f"Generated by `tests/plan_report.py` from `explain(\"formatted\")` at `{sf}`, `local[8]`, AQE on. This is",
        "the planned shape before AQE adapts it at runtime: AQE may still turn a sort-merge join into a broadcast",
        "join or split a skewed partition once it has measured the shuffle. Stream queries are left out; their",
        "registered DataFrames read the stream's sink. M5/M6 show only the last step after the checkpointed",
        "matching rounds.",
        "",
        "| query | shuffles | broadcasts | joins | partial aggs | scans (pushed filters) | top-k | python |",
        "|---|---|---|---|---|---|---|---|",
    ]
    for name, s in rows:
        lines.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['partial_aggregates']} | "
                     f"{s['scans']} ({s['pushed_filter_scans']}) | {'yes' if s['top_k'] else ''} | "
                     f"{s['python_nodes']} |")
    bad = [n for n, s in rows if s["nested_loop_or_cartesian"] or s["python_nodes"]]
    lines += ["", f"Queries with a nested-loop/cartesian join or a Python node: {', '.join(bad) or 'none'}."]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print(f"wrote PLANS.md ({len(rows)} queries)")


if __name__ == "__main__":
    main()

"""Plan inspection from ``explain("formatted")`` (the public API), for reviews and tests."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict:
    """Counts of the operators that matter at scale in the planned (pre-AQE) physical plan."""
    text = explain_text(df)
    tree = text.split("\n\n")[0]
    nodes = re.findall(r"[+:-]\s*(\w+)(?: \w+)*? \(\d+\)", tree) + re.findall(r"^(\w+) \(\d+\)", tree, re.M)
    def count(name):
        return sum(1 for n in nodes if n == name)
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                       r"CartesianProduct)\s+(\w+)", tree)
    return {
        "shuffles": count("Exchange"),
        "broadcasts": count("BroadcastExchange"),
        "joins": ", ".join(sorted({f"{a} {b}" for a, b in joins})) or "-",
        "nested_loop_or_cartesian": sum(1 for a, _ in joins if a in ("BroadcastNestedLoopJoin", "CartesianProduct")),
        "partial_aggregates": len(re.findall(r"Functions \[\d+\]: \[[^\n]*partial_", text)),
        "pushed_filter_scans": len(re.findall(r"PushedFilters: \[[^\]]+\]", text)),
        "scans": len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)),
        "top_k": "TakeOrderedAndProject" in tree,
        "python_nodes": len(re.findall(r"(BatchEvalPython|ArrowEvalPython|PythonUDF|MapInPandas|FlatMapGroupsInPandas)",
                                       text)),
    }

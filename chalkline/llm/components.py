"""Connected components of an undirected edge table, by smallest label and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id it reaches.

    A round takes the smallest label of an id's neighbours and then that label's own
    label, so a chain shortens at least by half a round or so; the rounds end when no
    label changes. Each round is a written table; only a count goes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.filter("a <> b").distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component"))
                   .select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("near")).select(F.col("a").alias("id"), "near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        new = saved(step.join(jump, "mid", "left").select(
            "id", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        changed = new.filter("old <> component").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels

"""Layers over a day-partitioned snapshot: changed rows as deltas, merged on read, compacted day by day.

A change job that touches a few rows of ``requests`` does not write the table again. It adds one layer with the whole
new rows of what changed (and ``_gone`` marks for what was removed)::

    <base>/requests/v=<n>/requested_date=<d>/                  the snapshot below, never touched
    <base>/requests_layers/layer=<id>/requested_date=<d>/      one layer of one run

The manifest (``sources.runs``) names what is live: ``layers[table][day] = {"bottom": id | "" | None, "deltas": [ids]}``.
``bottom`` None is the day's partition of the snapshot, "" an empty day, an id a layer that a compaction wrote. Layer
ids begin with the number of their manifest, so they sort in the order of publication and the largest id of a row wins.

Reading joins the deltas' ids only to the days that have deltas; all other days go by without a join or a shuffle, and a
bound on the day column prunes partitions of the snapshot and of the layers' rows (the deltas' ids alone are read for
all their days). The deltas of a day are small until they are compacted: the planner broadcasts their ids below its
measured threshold and shuffles them beyond it. A row keeps its day for life: its
time of request is never changed by a job.

An old manifest number gives the table as it was then (time travel), as long as its folders are kept.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.sources import schemas as sch
from chalkline.sources import tables as TB


def root(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}_layers"


def _schema(table: str) -> T.StructType:
    return T.StructType([*sch.TABLES[table].fields, T.StructField("_gone", T.BooleanType()),
                         T.StructField("layer", T.StringType()),
                         T.StructField(TB.DAY_PARTITIONS[table][0], T.DateType())])


def write_layer(changed: DataFrame, base: str, table: str, layer: str) -> list[str]:
    """Write rows (columns of ``table``, optionally ``_gone``) as ``layer``; returns the days that it holds."""
    part, ts_col = TB.DAY_PARTITIONS[table]
    gone = F.col("_gone") if "_gone" in changed.columns else F.lit(False)
    path = f"{root(base, table)}/layer={layer}"
    (changed.select(*[f.name for f in sch.TABLES[table].fields], gone.alias("_gone"), F.to_date(ts_col).alias(part))
     .write.mode("errorifexists").partitionBy(part).parquet(path))
    return layer_days(changed.sparkSession, base, table, layer)


def layer_days(spark: SparkSession, base: str, table: str, layer: str) -> list[str]:
    """Days of a written layer, from its folder names."""
    fs, path = TB._hadoop_fs(spark, f"{root(base, table)}/layer={layer}")
    head = TB.DAY_PARTITIONS[table][0] + "="
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(n[len(head):] for n in names if n.startswith(head))


def _read_leaves(spark: SparkSession, base: str, table: str, leaves: list[tuple[str, str]]) -> DataFrame:
    """Rows of (day, layer) folders in one scan; both are partition columns."""
    schema, part = _schema(table), TB.DAY_PARTITIONS[table][0]
    if not leaves:
        return spark.createDataFrame([], schema)
    top = root(base, table)
    return (spark.read.schema(schema).option("basePath", top)
            .parquet(*[f"{top}/layer={layer}/{part}={day}" for day, layer in leaves]))


#: Spark's folder name of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def on_days(part: str, days: list[str]):
    """The partition column is one of ``days`` (``NO_DAY`` for null); never null itself."""
    dates = [dt.date.fromisoformat(d) for d in days if d != NO_DAY]
    on = F.coalesce(F.col(part).isin(*dates), F.lit(False)) if dates else F.lit(False)
    return on | F.col(part).isNull() if NO_DAY in days else on


def read_layered(spark: SparkSession, base: str, table: str, manifest: dict) -> DataFrame:
    """``table`` as a manifest describes it: snapshot days, compacted days and the newest delta row of each id."""
    part, ts_col = TB.DAY_PARTITIONS[table]
    days = manifest.get("layers", {}).get(table, {})
    below = TB.read_table(spark, base, table, manifest["tables"][table])
    if part not in below.columns:
        below = below.withColumn(part, F.to_date(ts_col))
    columns = [f.name for f in sch.TABLES[table].fields] + [part]
    moved = sorted(d for d, e in days.items() if e["bottom"] is not None)
    touched = sorted(d for d, e in days.items() if e["deltas"])
    bottoms = below.select(columns)
    if moved:
        compacted = _read_leaves(spark, base, table, [(d, days[d]["bottom"]) for d in moved if days[d]["bottom"]])
        bottoms = bottoms.filter(~on_days(part, moved)).unionByName(compacted.select(columns))
    if not touched:
        return bottoms
    newest = newest_deltas(spark, base, table, days, touched)
    named = newest.select(F.col(part).alias("_day"), F.col("id").alias("_id"))
    kept = bottoms.filter(on_days(part, touched)).join(
        named, (F.col("id") == F.col("_id")) & F.col(part).eqNullSafe(F.col("_day")), "left_anti")
    return (bottoms.filter(~on_days(part, touched))
            .unionByName(kept.select(columns))
            .unionByName(newest.filter(~F.col("_gone")).select(columns)))


def newest_deltas(spark: SparkSession, base: str, table: str, days: dict, touched: list[str]) -> DataFrame:
    """The newest row per (day, id) of the deltas; rows are reduced map-side before the shuffle."""
    part = TB.DAY_PARTITIONS[table][0]
    rows = _read_leaves(spark, base, table, [(d, layer) for d in touched for layer in days[d]["deltas"]])
    rest = [c for c in rows.columns if c not in ("id", part, "layer")]
    return (rows.groupBy(part, "id").agg(F.max_by(F.struct(*rest), "layer").alias("r"))
            .select("id", part, *[F.col("r")[c].alias(c) for c in rest]))


def with_delta(layers: dict, layer: str, days: list[str]) -> dict:
    """The table's layer entry after a run added ``layer`` on ``days``."""
    out = dict(layers)
    for day in days:
        entry = out.get(day, {"bottom": None, "deltas": []})
        out[day] = {"bottom": entry["bottom"], "deltas": [*entry["deltas"], layer]}
    return out


def with_bottom(layers: dict, layer: str, days: list[str], written: list[str]) -> dict:
    """The entry after a compaction of ``days`` wrote ``layer``, which holds those that are not empty."""
    return {**layers, **{day: {"bottom": layer if day in written else "", "deltas": []} for day in days}}


def due_for_compaction(layers: dict, min_deltas: int = 1) -> list[str]:
    """Days with at least ``min_deltas`` deltas."""
    return sorted(day for day, entry in layers.items() if len(entry["deltas"]) >= min_deltas)

"""Domain table storage: explicit-schema reads and copy-on-write snapshots.

Layout under a base folder::

    <base>/<table>/v=<version>/part-*.parquet     immutable snapshots
    <base>/teacher_views/viewed_date=<d>/...        append-only fact, partitioned by day

A change job reads version N and writes version N+1 to a new folder; it never
overwrites the folder it reads, so a failed or retried job leaves version N
intact and readers always see a complete snapshot. The fact is partitioned
by ``viewed_date`` so the dashboards' ``viewed_at > as_of - interval``
filter prunes whole partitions (the date predicate is added beside the
timestamp predicate).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources import schemas as sch


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, *folders: str) -> None:
    """Delete folders that this run wrote and no longer reads."""
    for folder in folders:
        fs, path = _hadoop_fs(spark, folder)
        fs.delete(path, True)


def versions(spark: SparkSession, base: str, table: str, committed: bool = True) -> list[int]:
    """Written snapshot versions of a table (folders with a _SUCCESS marker; with ``committed=False`` any folder)."""
    fs, root = _hadoop_fs(spark, f"{base.rstrip('/')}/{table}")
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("v=") and (not committed or fs.exists(st.getPath().suffix("/_SUCCESS"))):
            out.append(int(name[2:]))
    return sorted(out)


#: Folder of the manifests that name the published version of every table (``sources.runs``).
MANIFESTS = "_manifests"


def newest_manifest(spark: SparkSession, base: str) -> dict | None:
    """The manifest with the highest number, or None in a warehouse without runs."""
    return newest_numbered(spark, f"{base.rstrip('/')}/{MANIFESTS}", "m")


def manifest_numbered(spark: SparkSession, base: str, n: int) -> dict:
    """Manifest ``n``, for reading tables as they were then."""
    found = newest_numbered(spark, f"{base.rstrip('/')}/{MANIFESTS}", "m", n)
    if found is None:
        raise FileNotFoundError(f"no manifest {n} under {base}")
    return found


def newest_numbered(spark: SparkSession, path: str, letter: str, n: int | None = None) -> dict | None:
    """The JSON file ``<letter>=<n>.json`` of number ``n`` (the highest by default) in a folder, or None."""
    fs, folder = _hadoop_fs(spark, path)
    if not fs.exists(folder):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    numbers = [int(x[2:-5]) for x in names if x.startswith(f"{letter}=") and x.endswith(".json")]
    if n is not None:
        numbers = [x for x in numbers if x == n]
    if not numbers:
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{letter}={max(numbers)}.json")
    data = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
    finally:
        data.close()


def current_version(spark: SparkSession, base: str, table: str) -> int:
    """The version readers see: the newest manifest's, or the last written one where no manifest names the table."""
    version = (newest_manifest(spark, base) or {"tables": {}})["tables"].get(table)
    if version is None:
        written = versions(spark, base, table)
        if not written:
            raise FileNotFoundError(f"no committed snapshot of {table} under {base}")
        version = written[-1]
    return version


# Day partition column derived from each fact's event time.
DAY_PARTITIONS = {"requests": ("requested_date", "requested_at"), "teacher_views": ("viewed_date", "viewed_at")}


def read_table(spark: SparkSession, base: str, table: str, version: int | None = None,
               manifest: int | None = None) -> DataFrame:
    """Read a table with its declared schema (never inferred); as last published by default, with its layers
    (``sources.layers``). ``manifest`` reads it as of that manifest number, ``version`` one snapshot without layers.
    A day-partitioned snapshot also exposes its partition column for pruning."""
    from pyspark.sql import types as T
    if version is None:
        seen = newest_manifest(spark, base) if manifest is None else manifest_numbered(spark, base, manifest)
        if seen and seen.get("layers", {}).get(table):
            from chalkline.sources import layers
            return layers.read_layered(spark, base, table, seen)
        version = current_version(spark, base, table) if manifest is None else seen["tables"][table]
    path = f"{base.rstrip('/')}/{table}/v={version}"
    schema = sch.TABLES[table]
    if table in DAY_PARTITIONS:
        fs, root = _hadoop_fs(spark, path)
        part = DAY_PARTITIONS[table][0]
        if any(st.getPath().getName().startswith(part + "=") for st in fs.listStatus(root)):
            schema = T.StructType(list(schema.fields) + [T.StructField(part, T.DateType())])
    return spark.read.schema(schema).parquet(path)


def partition_days(spark: SparkSession, base: str, table: str, version: int | None = None) -> list:
    """Dates of a day-partitioned table (with its layers) from folder names, newest first."""
    layered = {}
    if version is None:
        layered = ((newest_manifest(spark, base) or {}).get("layers", {})).get(table, {})
        version = current_version(spark, base, table)
    fs, root = _hadoop_fs(spark, f"{base.rstrip('/')}/{table}/v={version}")
    head = DAY_PARTITIONS[table][0] + "="
    names = [st.getPath().getName() for st in fs.listStatus(root)]
    return sorted({dt.date.fromisoformat(d) for d in [n[len(head):] for n in names if n.startswith(head)] + list(layered)
                   if d[:1].isdigit()},
                  reverse=True)


def write_snapshot(df: DataFrame, base: str, table: str, version: int, by_day: bool = False) -> str:
    """Write ``df`` as snapshot ``version`` of ``table``.

    A committed snapshot (folder with ``_SUCCESS``) is never overwritten. A
    folder left by a failed attempt (no ``_SUCCESS``) is replaced, so a job
    that died mid-write can simply be run again.
    """
    spark = df.sparkSession
    path = f"{base.rstrip('/')}/{table}/v={version}"
    if version in versions(spark, base, table):
        raise FileExistsError(f"snapshot {path} already exists")
    fs, p = _hadoop_fs(spark, path)
    mode = "overwrite" if fs.exists(p) else "errorifexists"
    cols = [f.name for f in sch.TABLES[table].fields]
    out = df.select(*cols)
    w = out.write.mode(mode)
    if by_day and table in DAY_PARTITIONS:
        part, ts_col = DAY_PARTITIONS[table]
        w = out.withColumn(part, F.to_date(ts_col)).write.mode(mode).partitionBy(part)
    w.parquet(path)
    return path


def append_views(df: DataFrame, path: str) -> None:
    """Append views to the day-partitioned fact (new files only)."""
    (df.select(*[f.name for f in sch.TEACHER_VIEWS.fields])
       .withColumn("viewed_date", F.to_date("viewed_at"))
       .write.mode("append").partitionBy("viewed_date").parquet(path))


def read_views(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import types as T
    schema = T.StructType(list(sch.TEACHER_VIEWS.fields) + [T.StructField("viewed_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def prune_by_day(df: DataFrame, lower_ts, part: str = "viewed_date") -> DataFrame:
    """Add the partition predicate implied by ``<event time> > lower_ts``."""
    if part not in df.columns:
        return df
    return df.filter(F.col(part) >= F.to_date(lower_ts))


# ---- deletes on the append-only view log -------------------------------------------
# Rewriting the whole view log to cascade a teacher delete (M2) would cost a
# full pass over the largest table per run. Instead the deleted ids are
# appended to a small tombstone table and applied as an anti join when the
# log is read; the planner broadcasts the tombstones only while they are below
# the measured size threshold and shuffles otherwise. A compaction job can
# rewrite day partitions later with ``compact_views``.

def append_tombstones(ids: DataFrame, path: str, key: str = "teacher_id") -> None:
    ids.select(F.col(ids.columns[0]).cast("long").alias(key)).distinct().write.mode("append").parquet(path)


def read_live_views(spark: SparkSession, path: str, tombstones: str | DataFrame | None = None,
                    key: str = "teacher_id") -> DataFrame:
    """The view log without rows whose ``key`` has been deleted (``tombstones``: a folder, or a frame of keys)."""
    views = read_views(spark, path)
    if tombstones is None:
        return views
    if isinstance(tombstones, DataFrame):
        return views.join(tombstones.select(key).distinct(), key, "left_anti")
    fs, p = _hadoop_fs(spark, tombstones)
    if not fs.exists(p):
        return views
    dead = spark.read.schema(f"{key} long").parquet(tombstones)
    return views.join(dead, key, "left_anti")


def compact_views(spark: SparkSession, path: str, tombstones: str, out_path: str) -> None:
    """Write the tombstone-filtered log to a new folder (day-partitioned)."""
    live = read_live_views(spark, path, tombstones)
    live.write.mode("errorifexists").partitionBy("viewed_date").parquet(out_path)

"""Runs that change several tables and become visible at once.

A run reads the published version of each table, writes new versions and side outputs (rejects, outcomes) to new
folders, and last of all publishes a manifest::

    <base>/_manifests/m=<n>.json    {"n", "run_id", "tables": {table: version}, "appends": {name: [paths]}, "outputs",
                                     "layers": {table: {day: ...}}}      changed rows over snapshots, sources.layers
    <base>/_runs/<run id>/<attempt>/<output>

Readers take table versions from the newest manifest (``tables.read_table``), so a run that dies between two tables
changes nothing that they see: its folders are numbers that no manifest names, and the next attempt takes others. A
manifest is written under another name and renamed to the next number, which fails if that number is taken: of two
runs that started from the same state only one is published, the other raises ``ConcurrentRun`` and can be run again.
A run whose id is published already writes nothing and returns the recorded outputs.

The first run of a warehouse publishes what is there as manifest 0, before it writes anything.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources import layers as LY
from chalkline.sources import schemas as sch
from chalkline.sources import tables as TB


class ConcurrentRun(RuntimeError):
    """Another run was published since this one read its tables."""


def publish_file(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write ``text`` under another name and rename it to ``name``; ``ConcurrentRun`` if that is taken."""
    fs, where = TB._hadoop_fs(spark, folder)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(where)
    draft = path(where, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(draft, path(where, name), plain)
    except Exception as e:  # the name is taken (any other cause shows in the message)
        raise ConcurrentRun(f"{name} of {folder} was not published: {e}") from e


def _publish(spark: SparkSession, base: str, manifest: dict) -> None:
    publish_file(spark, f"{base.rstrip('/')}/{TB.MANIFESTS}", f"m={manifest['n']}.json", json.dumps(manifest))


def published_run(spark: SparkSession, base: str, run_id: str) -> dict | None:
    """The manifest of a run id, or None."""
    fs, folder = TB._hadoop_fs(spark, f"{base.rstrip('/')}/{TB.MANIFESTS}")
    if not fs.exists(folder):
        return None
    rows = (spark.read.option("pathGlobFilter", "m=*.json").text(folder.toString())
            .filter(F.get_json_object("value", "$.run_id") == run_id).limit(1).collect())
    return json.loads(rows[0]["value"]) if rows else None


class Run:
    """One run: ``read`` tables, ``write`` their next versions, ``append`` folders, keep ``output`` frames, ``publish``."""

    def __init__(self, spark: SparkSession, base: str, run_id: str | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.run_id = run_id or uuid.uuid4().hex
        self.before = TB.newest_manifest(spark, self.base)
        if self.before is None:
            found = {t: v[-1] for t in sch.TABLES if (v := TB.versions(spark, self.base, t))}
            self.before = {"n": 0, "run_id": "adopted", "tables": found, "appends": {}, "outputs": {}, "layers": {}}
            _publish(spark, self.base, self.before)
        self.done = published_run(spark, self.base, self.run_id) if run_id else None
        self.tables, self.appends, self.outputs = {}, {}, {}
        self.layers = dict(self.before.get("layers", {}))
        self.layer_id = f"{self.before['n'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        self.folder = f"{self.base}/_runs/{self.run_id}/{uuid.uuid4().hex}"

    def version(self, table: str) -> int:
        """The version of ``table`` that this run reads."""
        if table not in self.before["tables"]:
            raise FileNotFoundError(f"no published snapshot of {table} under {self.base}")
        return self.before["tables"][table]

    def read(self, table: str) -> DataFrame:
        if self.before.get("layers", {}).get(table):
            return LY.read_layered(self.spark, self.base, table, self.before)
        return TB.read_table(self.spark, self.base, table, self.version(table))

    def write(self, table: str, df: DataFrame, by_day: bool = False) -> int:
        """Write ``df`` as a version of ``table`` that no other attempt has taken."""
        version = 1 + max([0, *TB.versions(self.spark, self.base, table, committed=False)])
        TB.write_snapshot(df, self.base, table, version, by_day)
        self.tables[table] = version
        self.layers.pop(table, None)
        return version

    def change(self, table: str, changed: DataFrame) -> list[str]:
        """Add the new rows of what changed (``_gone`` marks removed ones) as a layer; returns the days touched."""
        days = LY.write_layer(changed, self.base, table, self.layer_id)
        self.layers[table] = LY.with_delta(self.layers.get(table, {}), self.layer_id, days)
        return days

    def compact(self, table: str, min_deltas: int = 1) -> list[str]:
        """Write the days with at least ``min_deltas`` deltas again, and no other; returns them."""
        days = LY.due_for_compaction(self.layers.get(table, {}), min_deltas)
        if days:
            merged = self.read(table).filter(LY.on_days(TB.DAY_PARTITIONS[table][0], days))
            written = LY.write_layer(merged, self.base, table, self.layer_id)
            self.layers[table] = LY.with_bottom(self.layers[table], self.layer_id, days, written)
        return days

    def append(self, name: str, df: DataFrame) -> str:
        """Add a folder to those that make up ``name`` (tombstones, archives)."""
        path = self._side(name, df)
        self.appends.setdefault(name, []).append(path)
        return path

    def output(self, name: str, df: DataFrame) -> str:
        """Keep a frame of this run (rejects, outcomes)."""
        self.outputs[name] = self._side(name, df)
        return self.outputs[name]

    def _side(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return path

    def publish(self) -> dict:
        """Make all of it visible in one step; returns the manifest."""
        appends = {k: [*self.before["appends"].get(k, []), *self.appends.get(k, [])]
                   for k in {**self.before["appends"], **self.appends}}
        manifest = {"n": self.before["n"] + 1, "run_id": self.run_id, "tables": {**self.before["tables"], **self.tables},
                    "appends": appends, "outputs": self.outputs, "layers": self.layers}
        _publish(self.spark, self.base, manifest)
        return manifest


def read_appended(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """The published folders of ``name`` as one frame, or None if there are none."""
    paths = (TB.newest_manifest(spark, base) or {"appends": {}})["appends"].get(name, [])
    return spark.read.parquet(*paths) if paths else None

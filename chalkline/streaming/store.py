"""Published results of streams: folders that become visible by a commit, never by being written.

Layout under the folder of one stream::

    <base>/data/write=<unique>/...  one write each, never changed afterwards
    <base>/_commits/c=<n>.json      {"n", "batch", "tables": {name: [folders]}, "adds": {name: [folders]}}

A reader takes its folders from the commits alone: ``tables`` of the newest commit for results that are replaced,
``adds`` of all commits for results that only grow. So it sees the state before a batch or after it, whatever a
running or failed write has left behind. A commit is written under another name and renamed to the next number, which
fails if that number is taken; the change is then worked out again on the newer state.

``batch`` is the last micro-batch that is in the state. A batch that the engine runs again after a loss is skipped if
it was published and written anew, to another folder, if it was not. The stream's checkpoint belongs in the same
``base``: batch numbers mean nothing beside another one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chalkline.sources.runs import ConcurrentRun, publish_file
from chalkline.sources.tables import _hadoop_fs, delete, newest_numbered

COMMITS = "_commits"
EMPTY = {"n": -1, "batch": -1, "tables": {}, "adds": {}}

#: Versions of a replaced result that stay on disk behind the published one, for readers that are still at work.
KEPT_VERSIONS = 10


def newest(spark: SparkSession, base: str) -> dict:
    """The state of the newest commit; an empty one before the first."""
    return newest_numbered(spark, f"{base}/{COMMITS}", "c") or EMPTY


def new_folder(base: str) -> str:
    return f"{base}/data/write=w{uuid.uuid4().hex}"


def existing(spark: SparkSession, *folders: str) -> list[str]:
    """Those of ``folders`` that a write has made: a partition without rows has none."""
    found = []
    for folder in folders:
        fs, path = _hadoop_fs(spark, folder)
        if fs.exists(path):
            found.append(folder)
    return found


def commit(spark: SparkSession, base: str, change: Callable[[dict], dict | None]) -> dict | None:
    """Publish what ``change`` makes of the newest state (its keys ``batch``, ``tables``, ``adds``; absent: as before,
    no adds), or nothing where it returns None. Another writer's commit in between leads to another try, so
    each failed try means that some commit went through."""
    while True:
        state = newest(spark, base)
        new = change(state)
        if new is None:
            return None
        n = state["n"] + 1
        new = {"n": n, "batch": new.get("batch", state["batch"]), "adds": new.get("adds", {}),
               "tables": {**state["tables"], **new.get("tables", {})}}
        try:
            publish_file(spark, f"{base}/{COMMITS}", f"c={n}.json", json.dumps(new))
            return new
        except ConcurrentRun:
            if newest(spark, base)["n"] < n:   # not another writer: the file system refuses
                raise


def folders(spark: SparkSession, base: str, name: str) -> list[str]:
    """The published folders of ``name``: a table's from the newest commit, others from what each commit adds (a line
    per batch, read as text)."""
    state = newest(spark, base)
    if name in state["tables"] or state["n"] < 0:
        return state["tables"].get(name, [])
    rows = spark.read.option("pathGlobFilter", "c=*.json").text(f"{base}/{COMMITS}").collect()
    commits = sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["n"])
    return [f for c in commits if c["n"] <= state["n"] for f in c["adds"].get(name, [])]


def read_folders(spark: SparkSession, base: str, paths: list[str], schema: T.StructType) -> DataFrame:
    """Rows of folders below ``base``, partition columns of ``schema`` included; none where there are no folders."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/data").parquet(*paths).select(*schema.names)


def read(spark: SparkSession, base: str, name: str, schema: T.StructType) -> DataFrame:
    """The published rows of ``name``; none before the first commit."""
    return read_folders(spark, base, folders(spark, base, name), schema)


def publish_result(df: DataFrame, base: str, batch_id: int, name: str = "result") -> None:
    """Make ``df`` the whole of ``name`` as of ``batch_id``; older versions beyond ``KEPT_VERSIONS`` are deleted."""
    spark = df.sparkSession
    state = newest(spark, base)
    if batch_id <= state["batch"]:
        return
    folder = new_folder(base)
    df.write.parquet(folder)
    past = ([*state["tables"].get(f"past {name}", []), *state["tables"].get(name, [])])
    commit(spark, base, lambda now: {"batch": batch_id, "tables": {name: [folder], f"past {name}": past[-KEPT_VERSIONS:]}})
    delete(spark, *past[:-KEPT_VERSIONS])


def append_result(df: DataFrame, base: str, batch_id: int, name: str = "result") -> None:
    """Add ``df`` to ``name`` as part of ``batch_id``."""
    spark = df.sparkSession
    if batch_id <= newest(spark, base)["batch"]:
        return
    folder = new_folder(base)
    df.write.parquet(folder)
    commit(spark, base, lambda now: {"batch": batch_id, "adds": {name: [folder]}})

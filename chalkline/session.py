"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the jobs rely on. AQE re-plans joins from measured shuffle sizes
# (runtime broadcast only below the threshold, sort-merge above it), splits
# skewed join partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Cluster settings for very large inputs (hundreds of TB, ~1000 executors).
# Shuffle partitions start high and AQE coalesces them to ~advisory size, so
# no task holds more than ~256 MB of shuffle data; skewed partitions above
# 5x the median (and 512 MB) are split; broadcasts stay under 64 MB as
# measured at runtime; scans read 256 MB splits. Decommissioning migrates
# shuffle blocks off executors that are taken away; where the cluster runs
# an external shuffle service, also set spark.shuffle.service.enabled.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def shuffle_partitions_for(shuffle_bytes: float, target_bytes: float = 256 * 2**20,
                           minimum: int = 200) -> int:
    """Initial shuffle partitions for an expected shuffle volume (AQE coalesces down)."""
    n = int(-(-shuffle_bytes // target_bytes))
    return max(minimum, n)


def cluster_session(app_name: str = "chalkline", expected_shuffle_bytes: float = 100 * 2**40,
                    extra: dict | None = None) -> SparkSession:
    """Session for a cluster run: master, executors and spark.checkpoint.dir come
    from spark-submit / spark-defaults; this adds the scale settings above."""
    conf = dict(CLUSTER_CONF)
    conf.update(extra or {})
    return build_session(None, shuffle_partitions_for(expected_shuffle_bytes), app_name, conf)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "chalkline", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``shuffle_partitions`` should follow the data: about one partition per
    128 MB of shuffled data on a cluster, about the core count locally.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is. Only when
    it is unset (local tests) a scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise ValueError("set spark.checkpoint.dir to a shared folder for this session")
        return d
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
        d = tempfile.mkdtemp(prefix="chalkline-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"

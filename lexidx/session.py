"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package relies on.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Jackson's map keeps the last value of a repeated key; so do we.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Suggested settings for a large cluster (100 TB of documents, ~1000
# executors); the deployment applies them, this package does not force them.
CLUSTER_CONF = {
    # ~128-256 MB per task: a split of text tokenizes in a few seconds and its
    # per-document token arrays stay far below executor memory.
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # Start wide and let AQE coalesce to ~128 MB shuffle partitions.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # Hot (field, term) or version keys in joins are split by AQE.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state for the lifecycle machine.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", app: str = "lexidx",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench; cluster jobs bring their own."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings the operators depend on."""
    for k in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(k, SESSION_CONF[k])


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage.
    Only a local session (tests) may go without: there every task sees the
    driver's disk. Anywhere else a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="lexidx-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/lexidx/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, through the Hadoop FileSystem of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder (a version root has a handful)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def age_by_name(spark: SparkSession, path: str) -> None:
    """Give the data files of a folder modification times in the order of their names, all in the past."""
    jvm = spark.sparkContext._jvm
    names = [n for n in child_names(spark, path) if not n.startswith(("_", "."))]
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = int(time.time() * 1000) - len(names)
    for i, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), start + i, -1)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop FileSystem of the path (local, HDFS, s3a...)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

"""Orphaned artifacts: mark and sweep over what the storage really holds.

The storage is listed in parallel, without reading any content; what a version in
the catalog owns is marked; the rest, once nothing in it
has changed for a grace period, is a table of folders to delete. A writer that
is still at work keeps changing its folder, so the grace period spares it.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import catalog, commits
from lexidx.session import delete_path

GRACE_SECONDS = 6 * 3600
LISTING_TASKS = 32


def _visible(name: str, folder: bool) -> bool:
    """Does Spark's own listing see a file, or enter a folder, of this name?"""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _entries(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """The visible folders and files in a folder; none if it is gone by now."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                deeper = e.is_dir()
                if _visible(e.name, deeper):
                    folders.append(e.path) if deeper else files.append(e)
    except FileNotFoundError:
        pass
    return folders, files


LISTED_ROWS = 8192


def _listed(batches):
    """Rows for every file of the given folders, of those below them too where ``deep``."""
    rows = []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                           ["path", "bytes", "modified"])
        rows.clear()
        return batch

    for batch in batches:
        for folder, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            waiting = [folder]
            while waiting:
                folders, files = _entries(waiting.pop())
                if deep:
                    waiting += folders
                for e in files:
                    try:
                        st = e.stat()
                    except FileNotFoundError:
                        continue
                    if st.st_size:  # Spark's listing leaves out empty files
                        rows.append((os.fsencode(f"file:{e.path}").decode("utf-8", "replace"), st.st_size, st.st_mtime_ns // 1_000_000))
                    if len(rows) == LISTED_ROWS:
                        yield flush()
    if rows:
        yield flush()


def _list_local(spark: SparkSession, root: str) -> DataFrame:
    """``list_files`` on a local disk: the tasks walk the folders and the driver keeps no file, as it does for
    every file that Spark lists. The driver itself goes down only until there are folders enough to deal out."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    level, work = [root], []
    while level and len(level) < LISTING_TASKS:
        work += [(folder, False) for folder in level]
        level = [sub for folder in level for sub in _entries(folder)[0]]
    work += [(folder, True) for folder in level]
    tasks = min(len(work), max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame(work, "folder string, deep boolean").repartition(tasks).mapInArrow(
        _listed, "path string, bytes long, modified long")
    return found.withColumn("modified", F.timestamp_millis("modified"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of every visible file below ``root``.

    On a local disk the tasks list it. Elsewhere Spark does, which keeps every file's status on the driver: it lists
    folders in a job of its own, by default one task for each; here a few for each core.
    """
    local = commits.local_path(spark, root)
    if local is not None:
        return _list_local(spark, os.path.abspath(local))
    return _list_with_spark(spark, root)


def _list_with_spark(spark: SparkSession, root: str) -> DataFrame:
    width = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(width)
    spark.conf.set(width, str(max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(width, before)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def stored_folders(files: DataFrame, folder: str) -> DataFrame:
    """(artifact_key, folder, files, bytes, modified) of every artifact folder among ``files``.

    ``folder`` is a pattern with two groups: the path of the folder that belongs together below the root (first group
    of it all), and in it the artifact key.
    """
    f = files.select(F.regexp_extract("path", folder, 1).alias("folder"), F.regexp_extract("path", folder, 2).alias("artifact_key"), "bytes", "modified")
    return (f.where("artifact_key <> ''").groupBy("artifact_key", "folder")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")))


# A published version's attempts: index_id=<id>/version=<n>/data-<attempt>.
ATTEMPT_FOLDER = rf"((index_id=[^/]+/version=[^/]+)/{commits.ATTEMPT}[^/]+)/"


def committed_attempts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, live): every committed attempt, and whether the latest commit of its version names it."""
    files = f"{root.rstrip('/')}/index_id=*/version=*/{commits.FOLDER}/*.json"
    rows = (spark.read.schema("number long, attempt string").json(files)
            .select(F.regexp_extract(F.input_file_name(), r"(index_id=[^/]+/version=[^/]+)/", 1).alias("artifact_key"), "number", "attempt"))
    last = rows.groupBy("artifact_key").agg(F.max("number").alias("last"))
    return rows.join(last, "artifact_key").select(
        F.concat_ws("/", "artifact_key", "attempt").alias("folder"), (F.col("number") == F.col("last")).alias("live"))


def orphans(folders: DataFrame, versions: DataFrame, grace_seconds: float = GRACE_SECONDS, committed: DataFrame | None = None) -> DataFrame:
    """The delete list: (artifact_key, folder, reason, files, bytes, modified).

    A folder is an orphan if no UPLOADED or READY version owns its key (``NO_VERSION``), and with the
    ``committed`` attempts at hand also if no commit names it (``UNCOMMITTED``) or a later one replaced it
    (``SUPERSEDED``); never before ``grace_seconds`` have passed since its last change.
    """
    owned = versions.where(F.col("status").isin(*catalog.HAS_ARTIFACT)).select("artifact_key").distinct().withColumn("owned", F.lit(True))
    marked = folders.join(owned, "artifact_key", "left")
    if committed is None:
        live = F.lit(True)
    else:
        marked = marked.join(committed, "folder", "left")
        live = F.col("live")
    reason = (F.when(F.col("owned").isNull(), "NO_VERSION").when(live.isNull(), "UNCOMMITTED").when(~live, "SUPERSEDED"))
    quiet = F.col("modified") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(grace_seconds)).cast("decimal(18,6)"))
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull() & quiet).select(
        "artifact_key", "folder", "reason", "files", "bytes", "modified")


def orphaned_attempts(spark: SparkSession, root: str, versions: DataFrame, grace_seconds: float = GRACE_SECONDS) -> DataFrame:
    """The delete list of a publishing root."""
    return orphans(stored_folders(list_files(spark, root), ATTEMPT_FOLDER), versions, grace_seconds, committed_attempts(spark, root))


def sweep(spark: SparkSession, root: str, delete_list: DataFrame) -> int:
    """Delete the listed folders, one call each; a folder that is gone already counts as deleted. Returns how many."""
    n = 0
    for r in delete_list.select("folder").toLocalIterator():
        delete_path(spark, f"{root.rstrip('/')}/{r['folder']}")
        n += 1
    return n

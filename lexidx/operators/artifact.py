"""Artifacts: manifest, integrity, load and publish.

A published index version is a directory of Parquet tables plus a manifest
table (path, length, sha256) and a commit that names both (``commits``). Hashing
runs on the executors that read each file; nothing is packed or copied on one machine.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import catalog, commits, index
from lexidx.operators.commits import ATTEMPT, MANIFEST
from lexidx.session import path_exists
from lexidx.sources.files import hashed_objects

# Messages that must read as they do.
MISMATCH = "Downloaded artifact integrity check failed: expected size=%s checksum=%s, got size=%s checksum=%s"
COUNT_MISMATCH = "Loaded index doc count mismatch: expected %d but found %d"


def manifest(listing: DataFrame, root: str | None = None) -> DataFrame:
    """A1: (path, length, sha256) of every listed file, hashed already (``hashed_objects``) or here from its
    content; with ``root``, paths are made relative to it."""
    path = F.col("path")
    if root is not None:
        prefix = F.lit("/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/")
        path = F.substring(path, F.instr(path, prefix) + F.length(prefix), F.length(path))
    sha256 = F.col("sha256") if "sha256" in listing.columns else F.sha2("content", 256)
    return listing.select(path.alias("path"), "length", sha256.alias("sha256"))


DIGEST_BUCKETS = 4096


def version_digest(man: DataFrame) -> DataFrame:
    """One SHA-256 for a whole version, as a two-level hash tree: files are
    bucketed by a hash of their path (fixed fan-out), each bucket hashes its
    sorted ``path:length:sha256`` lines, and the top hashes the sorted
    bucket digests. No task ever holds more than one bucket's lines."""
    line = F.concat_ws(":", "path", F.col("length").cast("string"), "sha256")
    b = man.select(F.pmod(F.xxhash64("path"), F.lit(DIGEST_BUCKETS)).alias("_b"), line.alias("_l"), "length")
    per = b.groupBy("_b").agg(
        F.concat_ws(":", F.col("_b").cast("string"),
                    F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "\n"), 256)).alias("_d"),
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_s"))
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\n"), 256).alias("digest"),
                   F.sum("_n").alias("files"), F.sum("_s").alias("bytes"))


def integrity_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A3: full outer join of the expected manifest and the actual listing
    on path: OK / MISSING / EXTRA / SIZE / CHECKSUM, with the message."""
    e = expected.select("path", F.col("length").alias("exp_length"), F.col("sha256").alias("exp_sha256"))
    a = actual.select("path", F.col("length").alias("act_length"), F.col("sha256").alias("act_sha256"))
    j = e.join(a, "path", "full_outer")
    st = (F.when(F.col("act_length").isNull(), F.lit("MISSING"))
          .when(F.col("exp_length").isNull(), F.lit("EXTRA"))
          .when(F.col("exp_length") != F.col("act_length"), F.lit("SIZE"))
          .when(F.col("exp_sha256") != F.col("act_sha256"), F.lit("CHECKSUM"))
          .otherwise(F.lit("OK")))
    msg = F.when(st.isin("SIZE", "CHECKSUM"), F.format_string(
        MISMATCH, F.col("exp_length"), F.col("exp_sha256"), F.col("act_length"), F.col("act_sha256")))
    return j.select("path", "exp_length", "act_length", "exp_sha256", "act_sha256",
                    st.alias("status"), msg.alias("message"))


def doc_count_check(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A4: recorded vs loaded document counts per key (full outer join)."""
    j = expected.select(*keys, F.col("doc_count").alias("expected")).join(
        found.select(*keys, F.col("doc_count").alias("found")), keys, "full_outer")
    ex, fo = F.coalesce("expected", F.lit(0)), F.coalesce("found", F.lit(0))
    return j.select(*keys, ex.alias("expected"), fo.alias("found"), (ex == fo).alias("ok"),
                    F.when(ex != fo, F.format_string(COUNT_MISMATCH, ex, fo)).alias("message"))


# ---- publish and load (A9, A7) ------------------------------------------

def version_path(root: str, index_id, version) -> str:
    """A2 as a path: {root}/index_id={id}/version={v}."""
    return f"{root.rstrip('/')}/index_id={index_id}/version={version}"


def data_path(spark: SparkSession, root: str, index_id, version) -> str:
    """The folder with the tables of a published version: the attempt of its latest commit. A reader
    that keeps it goes on reading the same tables while the version is published again."""
    path = version_path(root, index_id, version)
    pinned = commits.latest(spark, path)
    if pinned is None:
        raise FileNotFoundError(f"Version {version} of index {index_id} has no commit")
    return pinned.data(path)


def publish_version(spark: SparkSession, docs: DataFrame, fields, root: str, index_id, version,
                    after_stored=None, layout: str = "range", retention: float = commits.RETENTION_SECONDS) -> DataFrame:
    """Write the tables, verify the document count, write the
    manifest, then commit; returns one row that describes what was published: index_id,
    version, doc_count, artifact_size, checksum, artifact_key, occurred_at.

    Every attempt writes a folder of its own, so nothing of an earlier one can
    be taken for part of it; the commit names the attempt that counts. Of two writers that publish the
    same version at once one wins, the other gets a ``PublishConflict``. An attempt that fails or loses removes
    its own files and leaves all others alone; attempts that were replaced
    stay for their readers until ``retention`` seconds have passed.
    """
    path = version_path(root, index_id, version)
    before = commits.latest(spark, path)
    name = f"{ATTEMPT}{uuid.uuid4().hex[:12]}"
    attempt = f"{path}/{name}"
    try:
        _, n_docs = index.write_version(docs, fields, attempt, layout=layout, after_stored=after_stored)
        index.verify_counts(n_docs, spark.read.parquet(f"{attempt}/stored").count())
        man = manifest(hashed_objects(spark, attempt), path)
        # One row for each file, written where the files were hashed.
        man.write.parquet(commits.manifest_path(path, name))
        d = version_digest(spark.read.parquet(commits.manifest_path(path, name))).first()
        done = commits.commit(spark, path, before, name, n_docs, d["files"], d["bytes"], d["digest"])
    except Exception:
        commits.discard_attempt(spark, path, name)
        raise
    commits.expire(spark, path, retention)
    now = _dt.datetime.fromtimestamp(done.committed_at, _dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame(
        [(str(index_id), int(version), done.doc_count, done.bytes, done.checksum, f"index_id={index_id}/version={version}", now)],
        "index_id string, version int, doc_count bigint, artifact_size bigint, checksum string, artifact_key string, occurred_at timestamp")


REQUIRED_COLUMNS = {
    "stored": ["doc_id"],
    "postings": index.POSTING_COLUMNS,
    "long_points": ["field", "value", "doc_id"],
    "double_points": ["field", "value", "doc_id"],
}


def format_problem(tables: index.IndexTables) -> str | None:
    """A7 format check: stored documents exist, and every table has its columns."""
    for name, cols in REQUIRED_COLUMNS.items():
        df = getattr(tables, name)
        if df is None:
            if name == "stored":
                return f"Index format check failed: table '{name}' is missing"
            continue
        missing = [c for c in cols if c not in df.columns]
        if missing:
            return f"Index format check failed: table '{name}' lacks {', '.join(missing)}"
    return None


class LoadRefused(RuntimeError):
    pass


def failure_text(e: Exception) -> str:
    """The first line of an error's message, or the name of its class."""
    return next((x.strip() for x in str(e).splitlines() if x.strip()), type(e).__name__)


def load_version(spark: SparkSession, root: str, index_id, version, versions: DataFrame,
                 register_as: str | None = None) -> DataFrame:
    """Gate -> integrity -> format -> doc count -> expose the tables.

    Status and document count come from the version's row of the catalog
    table ``versions`` (index_id, version, status, doc_count). Returns one
    status row (state, num_docs, size_on_disk_bytes, error, loaded_at); any
    error makes it FAILED. Temp views are only registered when every check passed.
    """
    path = version_path(root, index_id, version)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)

    def row(state, num_docs=None, size=None, error=None):
        return spark.createDataFrame(
            [(str(index_id), int(version), state, num_docs, size, error, now)],
            "index_id string, version int, state string, num_docs bigint, size_on_disk_bytes bigint, "
            "error string, loaded_at timestamp")

    def checked():
        known = versions.where((F.col("index_id").cast("string") == str(index_id))
                               & (F.col("version") == int(version))).select("status", "doc_count").first()
        if known is None:
            raise LoadRefused(f"Version {version} of index {index_id} not found")
        if known["status"] not in catalog.HAS_ARTIFACT:
            raise LoadRefused(catalog.NOT_AVAILABLE % (version, index_id, known["status"]))
        pinned = commits.latest(spark, path)
        if pinned is None or not path_exists(spark, pinned.manifest(path)):
            raise LoadRefused(f"Artifact manifest missing for version {version} of index {index_id}")
        expected, data = spark.read.parquet(pinned.manifest(path)), pinned.data(path)
        # Every file below the attempt that a reader can see, of whatever kind.
        actual = manifest(hashed_objects(spark, data), path)
        bad = integrity_check(expected, actual).where(F.col("status") != "OK").select("path", "status", "message")
        first_bad = bad.orderBy("path").first()
        if first_bad:
            raise LoadRefused(first_bad["message"] or f"Artifact file {first_bad['path']}: {first_bad['status']}")
        tables = index.read(spark, data)
        problem = format_problem(tables)
        if problem:
            raise LoadRefused(problem)
        n = tables.stored.count()
        if n != known["doc_count"]:
            raise LoadRefused(COUNT_MISMATCH % (known["doc_count"] or 0, n))
        return tables, n, int(expected.agg(F.sum("length")).first()[0] or 0)

    try:
        tables, n, size = checked()
    except Exception as e:  # noqa: BLE001 - whatever goes wrong, the load has failed
        return row("FAILED", error=failure_text(e))
    if register_as:
        for name, df in (("stored", tables.stored), ("postings", tables.postings), ("lengths", tables.lengths),
                         ("long_points", tables.long_points), ("double_points", tables.double_points),
                         ("terms", tables.written_terms), ("field_stats", tables.written_stats)):
            if df is not None:
                df.createOrReplaceTempView(f"{register_as}_{name}")
    return row("LOADED", num_docs=n, size=size)


# ---- archive audit (A5, A6) ---------------------------------------------

def _escapes(name) -> "F.Column":
    """Does the entry resolve outside the target directory after
    normalisation? Absolute names do; otherwise walk the segments and
    fail as soon as '..' climbs above the root."""
    walk = F.aggregate(
        F.split(name, "/"), F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(seg == "..", F.struct((acc["d"] - 1).alias("d"), (acc["out"] | (acc["d"] - 1 < 0)).alias("out")))
        .otherwise(F.struct((acc["d"] + 1).alias("d"), acc["out"].alias("out"))))
    return name.startswith("/") | walk["out"]


def audit_entries(entries: DataFrame) -> DataFrame:
    """A5 verdicts over an entries table (archive, position, entry, entry_type,
    size), checked in order: link, outside the target, neither file nor
    directory. ``first_failure`` marks the entry that stops the extraction of
    its archive: the refused one with the smallest position (an aggregate
    joined back, so an archive of any size is never one task's)."""
    t, name = F.col("entry_type"), F.col("entry")
    verdict = (F.when(t.isin("symlink", "hardlink"), F.lit("LINK"))
               .when(_escapes(name), F.lit("OUTSIDE_TARGET"))
               .when(~t.isin("file", "directory"), F.lit("UNSUPPORTED")).otherwise(F.lit("OK")))
    msg = (F.when(verdict == "LINK", F.format_string("Refusing to extract link tar entry '%s'", name))
           .when(verdict == "OUTSIDE_TARGET",
                 F.format_string("Refusing to extract tar entry outside target directory: '%s'", name))
           .when(verdict == "UNSUPPORTED", F.format_string("Refusing to extract unsupported tar entry '%s'", name)))
    out = entries.select("archive", "position", "entry", "entry_type", "size",
                         verdict.alias("verdict"), msg.alias("message"))
    stops = (out.where(F.col("verdict") != "OK").groupBy("archive").agg(F.min("position").alias("_stop")))
    return out.join(stops, "archive", "left").select(
        *out.columns, F.coalesce(F.col("position") == F.col("_stop"), F.lit(False)).alias("first_failure"))


def unpacked_size(entries: DataFrame) -> DataFrame:
    """Bytes of regular files per archive (a partial aggregate)."""
    return entries.groupBy("archive").agg(
        F.sum(F.when(F.col("entry_type") == "file", F.col("size")).otherwise(0)).alias("total_bytes"),
        F.count(F.lit(1)).alias("entries"))

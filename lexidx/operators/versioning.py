"""Build one index version end to end and report it as lifecycle events.

NDJSON lines -> validation -> stored/postings/points -> manifest -> the
BUILT and UPLOADED events (or one FAILED event), ready to append to the
lifecycle log that ``catalog.fold_versions`` and the streaming state machine
read. The happy path reads the input once: the number of bad lines and the
first bad line are observed while the stored table is written.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import artifact, catalog, validate
from lexidx.sources import ndjson
from lexidx.streaming.events import LIFECYCLE_SCHEMA


class BuildFailed(RuntimeError):
    pass


class BuildConflict(RuntimeError):
    """The index already has a CREATED or BUILDING version."""


def _event_rows(spark: SparkSession, version_id, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(str(version_id), *r) for r in rows], LIFECYCLE_SCHEMA)


def build_version(spark: SparkSession, source: str, fields, root: str, index_id, version: int,
                  version_id: str | int, first_seq: int = 0, created: bool = True,
                  versions: DataFrame | None = None, layout: str = "range") -> DataFrame:
    """Build and publish a version from the NDJSON at ``source``.

    Returns lifecycle events: CREATED (the accepted request; leave it out
    with ``created=False`` when the version already exists), BUILDING, then
    BUILT and UPLOADED on success, or FAILED on any error: with the first
    error (``Line N: ...``) when a line fails, else with the message of what went
    wrong. A failed build removes what it wrote and leaves no manifest, so the
    version can never be loaded. Version ids are strings (UUIDs).
    """
    if versions is not None:
        # C7 before creating: one small aggregate over this index's versions.
        busy = catalog.active_builds(versions.where(F.col("index_id") == F.lit(index_id)))
        hit = busy.where(F.col("active_count") > 0).select("message").first()
        if hit:
            raise BuildConflict(hit.message)
    now = lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    head = [(first_seq, now(), "CREATED", None, None, None, None, None)] if created else []
    first_seq += len(head)
    started = (first_seq, now(), "BUILDING", None, None, None, None, None)
    try:
        checked = validate.validate(ndjson.parse(ndjson.read_lines(spark, source)), fields)
        obs = Observation(f"build_checks_{uuid.uuid4().hex[:8]}")
        watched = checked.observe(obs, F.count(F.when(F.col("status") != "OK", F.lit(1))).alias("bad"))
        docs = validate.typed_documents(watched, fields)

        def stop_if_bad():
            if obs.get["bad"]:
                first = validate.first_error(checked, fields).first()
                raise BuildFailed(first["message"] if first else "IndexBuildException")

        pub = artifact.publish_version(spark, docs, fields, root, index_id, version,
                                       after_stored=stop_if_bad, layout=layout).collect()[0]
    except Exception as e:  # noqa: BLE001 - every failure of a build is an event
        return _event_rows(spark, version_id, head + [
            started, (first_seq + 1, now(), "FAILED", None, None, None, None, artifact.failure_text(e))])
    return _event_rows(spark, version_id, head + [
        started,
        (first_seq + 1, now(), "BUILT", pub.doc_count, pub.artifact_size, pub.checksum, None, None),
        (first_seq + 2, now(), "UPLOADED", None, None, None, pub.artifact_key, None)])


def uploaded_events(events: DataFrame, index_id, version: int) -> DataFrame:
    """E1 payload of a build: the seven-field uploaded event (versionId,
    indexId, versionNumber, artifactKey, artifactSize, checksum, occurredAt)
    from the build's BUILT and UPLOADED rows; empty when the build failed."""
    built = events.where(F.col("kind") == "BUILT").select(
        "version_id", F.col("artifact_size").alias("artifactSize"), "checksum")
    up = events.where(F.col("kind") == "UPLOADED").select(
        "version_id", F.col("artifact_key").alias("artifactKey"), F.col("ts").alias("occurredAt"))
    return up.join(built, "version_id").select(
        F.col("version_id").cast("string").alias("versionId"), F.lit(str(index_id)).alias("indexId"),
        F.lit(int(version)).alias("versionNumber"), "artifactKey", "artifactSize", "checksum", "occurredAt")

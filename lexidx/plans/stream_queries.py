"""Registered streaming queries.

Each query writes its input records (derived from the driver's tables) to a
fresh folder below the shared checkpoint root, runs a Structured Streaming
query over it with ``availableNow`` and its own checkpoint, and returns the
sink's contents as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import catalog
from lexidx.plans import fixtures, tables
from lexidx.session import scratch_path
from lexidx.streaming import events as ev

# Which uploaded events are poisoned or lost in the fixtures.
POISON_STRING_MOD = 97
POISON_NO_ID_MOD = 89
POISON_TYPE_MOD = 83
UNCONFIRMED_MOD = 3
REFUSED_MOD = 7


def uploaded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-field uploaded events of the G2 versions that have an artifact."""
    v = fixtures.index_version(spark, sf_dir).where(F.col("status").isin(*catalog.HAS_ARTIFACT))
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), "o_orderdate")
    return v.join(o, "version_id").select(
        F.col("version_id").cast("string").alias("versionId"), F.col("index_id").cast("string").alias("indexId"),
        F.col("version").alias("versionNumber"), F.col("artifact_key").alias("artifactKey"),
        F.col("artifact_size").alias("artifactSize"), "checksum",
        F.col("o_orderdate").cast("timestamp").alias("occurredAt"))


def _records_with_poison(spark, sf_dir):
    """Good records plus three kinds that must not decode: a bare string, an
    object without id, an object whose version number is no number."""
    e = uploaded_events(spark, sf_dir)
    good = ev.encode(e, "indexId")
    vid = F.col("versionId").cast("bigint")
    bad_str = e.where(vid % POISON_STRING_MOD == 0).select(
        F.col("indexId").alias("key"), F.concat(F.lit('"poison '), F.col("versionId"), F.lit('"')).alias("value"))
    no_id = e.where((vid % POISON_NO_ID_MOD == 0) & (vid % POISON_STRING_MOD != 0)).select(
        F.col("indexId").alias("key"), F.concat(F.lit('{"indexId": "'), F.col("indexId"), F.lit('"}')).alias("value"))
    bad_type = e.where(vid % POISON_TYPE_MOD == 0).select(F.col("indexId").alias("key"), F.concat(
        F.lit('{"versionId": "'), F.col("versionId"), F.lit('", "versionNumber": "abc"}')).alias("value"))
    return good.unionByName(bad_str).unionByName(no_id).unionByName(bad_type)


def event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the events as keyed JSON records; read key and value back."""
    out = scratch_path(spark, "events-out")
    ev.write_records(ev.encode(uploaded_events(spark, sf_dir), "indexId"), "text", out)
    return ev.from_lines(ev.read_raw(spark, "text", out, streaming=False)).select("key", "value")


def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the published records from the earliest one and decode."""
    src = scratch_path(spark, "events-src")
    ev.write_records(ev.encode(uploaded_events(spark, sf_dir), "indexId"), "text", src)
    stream = ev.decode(ev.from_lines(ev.read_raw(spark, "text", src)), ev.UPLOADED_EVENT_SCHEMA, "versionId")
    sink, ck = scratch_path(spark, "events-decoded"), scratch_path(spark, "ck-events")
    ev.run_available(stream.select("event.*"), sink, ck)
    out = spark.read.parquet(sink)
    return out.withColumn("occurredAt", F.col("occurredAt").cast("string"))


def poison_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecodable records go to the dead-letter sink with key, text and original bytes."""
    src = scratch_path(spark, "events-poison")
    ev.write_records(_records_with_poison(spark, sf_dir), "text", src)
    stream = ev.dead_letters(ev.decode(ev.from_lines(ev.read_raw(spark, "text", src)), ev.UPLOADED_EVENT_SCHEMA, "versionId"))
    sink, ck = scratch_path(spark, "dlt"), scratch_path(spark, "ck-dlt")
    ev.run_available(stream, sink, ck)
    return spark.read.parquet(sink).select("key", "value", F.sha2("raw", 256).alias("raw_sha256"), "reason")


def _lifecycle_outcomes(spark, sf_dir):
    """Stream the G3 lifecycle log through the keyed state machine: one keyed
    record per event, in the files of one ordered log, micro-batches of the default bound."""
    src = scratch_path(spark, "lifecycle-src")
    ev.write_log(fixtures.lifecycle_events(spark, sf_dir), "version_id", "seq", src)
    records = ev.from_lines(ev.read_raw(spark, "text", src))
    decoded = ev.decode(records, ev.LIFECYCLE_SCHEMA, "version_id")
    stream = ev.apply_transitions(decoded.where(F.col("event").isNotNull()).select("event.*", "key", "raw"))
    sink, ck = scratch_path(spark, "lifecycle-out"), scratch_path(spark, "ck-lifecycle")
    ev.run_available(stream, sink, ck)
    return spark.read.parquet(sink).withColumn("version_id", F.col("version_id").cast("bigint"))


def ready_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current status and applied-event count per version from the stream."""
    o = _lifecycle_outcomes(spark, sf_dir)
    return o.where(F.col("status").isNotNull()).groupBy("version_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.count(F.when(F.col("outcome") == "APPLIED", F.lit(1))).alias("applied_events"))


def unknown_version_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for versions that do not exist (yet) go to the dead-letter
    sink; what comes back is read from the payload kept there."""
    sink = scratch_path(spark, "dlt-unknown")
    ev.unknown_versions(_lifecycle_outcomes(spark, sf_dir)).write.parquet(sink)
    event = F.from_json(F.decode("raw", "UTF-8"), ev.LIFECYCLE_SCHEMA)
    return spark.read.parquet(sink).select(F.col("key").cast("bigint").alias("version_id"), event["seq"].alias("seq"),
                                           event["kind"].alias("kind"), "reason")


def stale_failure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: FAILED events ignored because the version was already READY."""
    o = _lifecycle_outcomes(spark, sf_dir)
    return o.where((F.col("kind") == "FAILED") & (F.col("outcome") == "STALE")).select("version_id", "seq")


def ambiguous_publish_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third UPLOADED version's event was never confirmed; re-emit it."""
    v = fixtures.index_version(spark, sf_dir)
    published = v.where(F.col("status").isin(*catalog.HAS_ARTIFACT)
                        & (F.col("version_id") % UNCONFIRMED_MOD != 0))
    return ev.reconcile_uploaded(v, published).select("version_id", "index_id", "version", "artifact_key")


def publish_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every version with an artifact after its event was acknowledged, timed out or refused."""
    v = fixtures.index_version(spark, sf_dir).where(F.col("status").isin(*catalog.HAS_ARTIFACT)).withColumn(
        "version_id", F.col("version_id").cast("string"))
    vid = F.col("version_id").cast("bigint")
    result = F.when(vid % UNCONFIRMED_MOD == 0, "TIMEOUT").when(vid % REFUSED_MOD == 0, "ERROR").otherwise("ACK")
    results = v.select("version_id", vid.alias("seq"), result.alias("result"),
                       F.when(result == "ERROR", F.concat(F.lit("broker "), F.col("index_id").cast("string"))).alias("error"))
    src, out, ck = (scratch_path(spark, x) for x in ("publish-results", "publish-settled", "ck-settled"))
    results.write.json(src)
    stream = spark.readStream.schema(ev.RESULT_SCHEMA).options(**ev.FILE_BOUND).json(src)
    ev.run_available(stream, out, ck, batch_fn=ev.settle_batch(out, v))
    failed, orphans = ev.settled(spark, out)
    return (v.select("version_id", "status", "artifact_key").join(failed.select("version_id", "kind", "error_message"), "version_id", "left")
            .join(orphans.select("version_id", F.col("artifact_key").alias("orphaned_key")), "version_id", "left")
            .select(F.col("version_id").cast("bigint").alias("version_id"), F.coalesce("kind", "status").alias("status"),
                    F.when(F.col("kind").isNull(), F.col("artifact_key")).alias("artifact_key"), "orphaned_key", "error_message"))


QUERIES = {
    "event_source": event_source,
    "event_sink": event_sink,
    "poison_routing": poison_routing,
    "ready_transition": ready_transition,
    "unknown_version_routing": unknown_version_routing,
    "stale_failure_guard": stale_failure_guard,
    "ambiguous_publish_reconcile": ambiguous_publish_reconcile,
    "publish_settlement": publish_settlement,
}

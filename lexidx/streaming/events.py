"""Lifecycle events over Structured Streaming.

Events travel as JSON records keyed by index id. The source is ``kafka``
on a cluster (``startingOffsets=earliest``) or a folder of JSON lines in
tests; both give a raw ``value`` string, decoded with ``from_json`` against
a fixed schema. Undecodable records are routed, with their original text, to
a dead-letter sink by a query of their own. The keyed state machine of the
lifecycle runs in ``applyInPandasWithState``: one small per-event rule,
with Spark partitioning the versions, by buckets of their ids, and keeping the
state fault-tolerantly in the checkpoint.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from lexidx.operators import commits
from lexidx.session import age_by_name, path_exists

# The uploaded event: seven fields, as published.
UPLOADED_EVENT_SCHEMA = T.StructType([
    T.StructField("versionId", T.StringType()),
    T.StructField("indexId", T.StringType()),
    T.StructField("versionNumber", T.IntegerType()),
    T.StructField("artifactKey", T.StringType()),
    T.StructField("artifactSize", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("occurredAt", T.TimestampType()),
])

# A general lifecycle event (the batch fold's input, as a record).
LIFECYCLE_SCHEMA = T.StructType([
    T.StructField("version_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("doc_count", T.LongType()),
    T.StructField("artifact_size", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("artifact_key", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


KAFKA_BOUND = {"maxOffsetsPerTrigger": "1000000"}
FILE_BOUND = {"maxFilesPerTrigger": "64"}


def read_raw(spark: SparkSession, fmt: str, path_or_topic: str, options: dict | None = None,
             streaming: bool = True) -> DataFrame:
    """Raw records as (key STRING, value STRING, raw BINARY); ``raw``
    keeps the record's original bytes for the dead-letter sink.

    ``maxOffsetsPerTrigger`` (kafka) and ``maxFilesPerTrigger`` (files) bound a
    micro-batch, because the state machine holds one key's events of one
    micro-batch in memory; ``options`` may change the defaults.
    """
    r = spark.readStream if streaming else spark.read
    if streaming:
        options = {**(KAFKA_BOUND if fmt == "kafka" else FILE_BOUND), **(options or {})}
    if fmt == "kafka":
        r = r.format("kafka").option("subscribe", path_or_topic).option("startingOffsets", "earliest")
        for k, v in (options or {}).items():
            r = r.option(k, v)
        return r.load().select(F.col("key").cast("string").alias("key"),
                               F.col("value").cast("string").alias("value"), F.col("value").alias("raw"))
    df = r.format("text")
    for k, v in (options or {}).items():
        df = df.option(k, v)
    return df.load(path_or_topic).select(F.lit(None).cast("string").alias("key"), "value",
                                         F.encode("value", "UTF-8").alias("raw"))


CORRUPT = "_corrupt_record"


def decode(raw: DataFrame, schema: T.StructType, required: str) -> DataFrame:
    """from_json with the fixed schema; ``event`` is NULL when the record is
    not one object, lacks the ``required`` field, or has a value that does not
    fit its field's type."""
    strict = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ev = F.from_json(F.col("value"), strict, {"columnNameOfCorruptRecord": CORRUPT})
    ok = F.col("value").rlike(r"^\s*\{") & ev.isNotNull() & ev[CORRUPT].isNull() & ev[required].isNotNull()
    return raw.select("key", "value", "raw", F.when(ok, ev.dropFields(CORRUPT)).alias("event"))


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Records that do not decode, with their original bytes."""
    return decoded.where(F.col("event").isNull()).select(
        "key", "value", "raw", F.lit("UNDECODABLE").alias("reason"))


def encode(events: DataFrame, key_col: str) -> DataFrame:
    """(key, value) records: the key column plus the event as JSON."""
    return events.select(F.col(key_col).cast("string").alias("key"),
                         F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value"))


def _as_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct("key", "value")).alias("value"))


def from_lines(raw: DataFrame) -> DataFrame:
    """Records of the file sink as (key, value, raw): what a topic would deliver.

    A line that is no such record stays as it is, without a key.
    """
    rec = F.from_json("value", "key string, value string, _corrupt_record string", {"columnNameOfCorruptRecord": CORRUPT})
    ok = rec.isNotNull() & rec[CORRUPT].isNull() & rec["value"].isNotNull()
    value = F.when(ok, rec["value"]).otherwise(F.col("value"))
    return raw.select(F.when(ok, rec["key"]).alias("key"), value.alias("value"),
                      F.when(ok, F.encode(rec["value"], "UTF-8")).otherwise(F.col("raw")).alias("raw"))


def write_records(records: DataFrame, fmt: str, target: str, options: dict | None = None) -> None:
    """E1 sink (batch): ``kafka`` topic, or files of one JSON record {"key", "value"} a line."""
    if fmt == "kafka":
        w = records.write.format("kafka").option("topic", target)
        for k, v in (options or {}).items():
            w = w.option(k, v)
        w.save()
    else:
        _as_lines(records).write.mode("append").text(target)


LOG_RECORDS = 10_000


def write_log(events: DataFrame, key_col: str, order: str, target: str, records_per_file: int = LOG_RECORDS) -> None:
    """An ordered log as a folder of files: ranges of ``order``, of at most ``records_per_file`` records, which a
    stream takes up in that order, a bounded number of files at a time (``read_raw``).

    The file source goes by modification times, so these follow the ranges (on storage that keeps
    none, append the ranges one after the other). A topic needs none of this: its partitions are ordered.
    """
    dealt = events.repartitionByRange(order).sortWithinPartitions(order)
    _as_lines(encode(dealt, key_col)).write.option("maxRecordsPerFile", records_per_file).text(target)
    age_by_name(events.sparkSession, target)


def publish_stream(records: DataFrame, fmt: str, target: str, checkpoint: str, options: dict | None = None):
    """E1 sink (streaming): keyed records to a ``kafka`` topic or to files of one
    JSON record {"key", "value"} a line; the checkpoint makes the file sink exactly-once."""
    if fmt == "kafka":
        w = records.writeStream.option("checkpointLocation", checkpoint).format("kafka").option("topic", target)
        for k, v in (options or {}).items():
            w = w.option(k, v)
        return w.start()
    return (_as_lines(records).writeStream.option("checkpointLocation", checkpoint)
            .format("text").start(target))


# ---- keyed state machine (E3-E5) ----------------------------------------

# Versions share a state entry by the hash of their id: Spark hands over each group and takes its state back at a
# fixed cost of milliseconds, whatever the group holds. Fixed for the life of a checkpoint, like its partitions.
STATE_BUCKETS = 1024
ROW_FIELDS = ("status", "doc_count", "artifact_size", "checksum", "artifact_key", "error_message",
              "applied_events", "created_at", "updated_at")
# The rows of a bucket's versions as a JSON list of [version_id, *ROW_FIELDS]; times are microseconds.
STATE_SCHEMA = T.StructType([T.StructField("versions", T.StringType())])
OUTCOME_SCHEMA = T.StructType([
    T.StructField("version_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("status", T.StringType()),
    # The record of an event that found no version, for the dead letters.
    T.StructField("key", T.StringType()),
    T.StructField("raw", T.BinaryType()),
])


def _long(v):
    """pandas gives float64 (NaN for null) to integer columns with nulls."""
    return None if v is None or pd.isna(v) else int(v)


def _text(v):
    return None if v is None or (not isinstance(v, str) and pd.isna(v)) else str(v)


def _step(st: dict | None, e) -> tuple[dict | None, str]:
    """One event against the current row (None = the version does not exist)."""
    k = e.kind
    if st is None:
        if k != "CREATED":
            return None, "NOT_FOUND"
        return {"status": "CREATED", "doc_count": None, "artifact_size": None, "checksum": None,
                "artifact_key": None, "error_message": None, "applied_events": 1,
                "created_at": e.ts, "updated_at": e.ts}, "APPLIED"
    if k == "CREATED":
        return st, "DUPLICATE"
    if k == "READY":
        if st["status"] == "READY":
            return st, "DUPLICATE"
        if st["status"] != "UPLOADED":
            return st, "STALE"
    if k == "FAILED" and st["status"] == "READY":
        return st, "STALE"
    st = dict(st, status=k, applied_events=st["applied_events"] + 1, updated_at=e.ts)
    if k == "BUILT":
        st.update(doc_count=_long(e.doc_count), artifact_size=_long(e.artifact_size), checksum=_text(e.checksum))
    elif k == "UPLOADED":
        st.update(artifact_key=_text(e.artifact_key))
    elif k == "FAILED":
        st.update(error_message=_text(e.error_message), doc_count=None, artifact_size=None,
                  checksum=None, artifact_key=None)
    return st, "APPLIED"


SEED_PREFIX = "cat_"
SEED_FIELDS = ("status", "doc_count", "artifact_size", "checksum", "artifact_key", "error_message")


def _seed(e) -> dict | None:
    """The catalog row an event carries (stream-static join), if any."""
    if _text(getattr(e, SEED_PREFIX + "status", None)) is None:
        return None
    st = {f: (_long if f in ("doc_count", "artifact_size") else _text)(getattr(e, SEED_PREFIX + f)) for f in SEED_FIELDS}
    st.update(applied_events=0, created_at=None, updated_at=None)
    return st


def _rows(state) -> dict:
    """The version rows of a bucket, as lists until an event meets them."""
    return {row[0]: row[1:] for row in json.loads(state.get[0])} if state.exists else {}


def _packed(versions: dict) -> str:
    def row(st):
        return st if isinstance(st, list) else [_long(st[f]) if f.endswith("_at") else st[f] for f in ROW_FIELDS]
    return json.dumps([[v, *row(st)] for v, st in versions.items()], ensure_ascii=False, separators=(",", ":"))


def _transition(key, batches, state):
    """All events of one bucket of versions in one micro-batch, in log order.

    Arrival order within a key is not kept by a shuffle, so the rows are
    sorted; the source bounds how many a micro-batch can hold (``read_raw``).
    """
    rows = [e for pdf in batches for e in pdf.itertuples(index=False)]
    rows.sort(key=lambda e: e.seq)
    versions, changed = _rows(state), False
    out = []
    for e in rows:
        v = _text(e.version_id)
        was = versions.get(v)
        if was is None:
            st = _seed(e)
        else:
            st = was if isinstance(was, dict) else dict(zip(ROW_FIELDS, was, strict=True))
        seeded = was is None and st is not None
        st, outcome = _step(st, e)
        lost = outcome == "NOT_FOUND"
        out.append((v, int(e.seq), e.kind, outcome, st["status"] if st else None,
                    _text(e.key) if lost else None, e.raw if lost else None))
        if st is not None:  # ids no version has leave no state behind
            versions[v] = st
            changed = changed or seeded or outcome == "APPLIED"
    if changed:
        state.update((_packed(versions),))
    yield pd.DataFrame(out, columns=[f.name for f in OUTCOME_SCHEMA.fields])


def apply_transitions(events: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """E3/E5 (and E4's NOT_FOUND): per-event outcomes of the lifecycle rules
    for each version, whose state is kept by bucket. Events of one version must come through one ordered
    log; within a micro-batch they are sorted by seq. The current status alone
    decides: a second READY or CREATED is a duplicate, whatever its position.

    ``catalog`` (a static version table) seeds the state of versions that
    existed before the stream: a stream-static left join attaches the row to
    each event, read only when the key has no state yet. ``key`` and ``raw`` of the
    record, where the events carry them, come back with NOT_FOUND outcomes.
    """
    for name, kind in (("key", "string"), ("raw", "binary")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    events = events.withColumn("version_id", F.col("version_id").cast("string"))
    if catalog is not None:
        seed = catalog.select(F.col("version_id").cast("string").alias("version_id"),
                              *[F.col(f).alias(SEED_PREFIX + f) for f in SEED_FIELDS])
        events = events.join(seed, "version_id", "left")
    # Longs as text: a null beside them must not turn them into floating point.
    events = events.withColumns({
        **{c: F.col(c).cast("bigint").cast("string") for c in events.columns if c.endswith(("doc_count", "artifact_size"))},
        "ts": F.unix_micros(F.col("ts").cast("timestamp")), "bucket": F.pmod(F.xxhash64("version_id"), F.lit(STATE_BUCKETS))})
    return events.groupBy("bucket").applyInPandasWithState(
        _transition, OUTCOME_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def unknown_versions(outcomes: DataFrame) -> DataFrame:
    """Dead letters of events for versions that do not exist, with key and original bytes."""
    return outcomes.where(F.col("outcome") == "NOT_FOUND").select(
        "key", F.decode("raw", "UTF-8").alias("value"), "raw", F.lit("UNKNOWN_VERSION").alias("reason"))


def run_available(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet", batch_fn=None):
    """Drive a streaming query over everything available, then stop."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if batch_fn is not None:
        q = w.foreachBatch(batch_fn).start()
    else:
        q = w.format(fmt).outputMode("append").option("path", sink_path).start()
    q.awaitTermination()
    return q


def uploaded_to_ready(decoded: DataFrame) -> DataFrame:
    """The uploaded event asks for UPLOADED -> READY: one READY lifecycle
    event per record, ordered by event time."""
    e = F.col("event")
    return decoded.where(e.isNotNull()).select(
        e["versionId"].alias("version_id"),
        F.unix_micros(e["occurredAt"]).alias("seq"), e["occurredAt"].alias("ts"), F.lit("READY").alias("kind"),
        F.lit(None).cast("bigint").alias("doc_count"), e["artifactSize"].alias("artifact_size"),
        e["checksum"].alias("checksum"), e["artifactKey"].alias("artifact_key"),
        F.lit(None).cast("string").alias("error_message"), "key", "raw")


def settle_publish(outcomes: DataFrame, versions: DataFrame):
    """Settle the results of publishing uploaded events.

    ``outcomes``: (version_id, seq, result, error) with result ACK, TIMEOUT or
    ERROR; ``seq`` is the position the FAILED event takes in the log. ACK
    needs nothing (the listener moves the version to READY); TIMEOUT is an
    unknown outcome: the version stays UPLOADED and keeps its
    artifact (``reconcile_uploaded`` re-sends later, which is safe because
    the READY transition is idempotent); ERROR fails the version and its
    artifact becomes an orphan to delete. Returns (FAILED lifecycle events,
    artifact keys to delete).
    """
    err = outcomes.where(F.col("result") == "ERROR").join(
        versions.select("version_id", "artifact_key"), "version_id", "left")
    failed = err.select(
        "version_id", F.col("seq").cast("bigint").alias("seq"), F.current_timestamp().alias("ts"),
        F.lit("FAILED").alias("kind"), F.lit(None).cast("bigint").alias("doc_count"),
        F.lit(None).cast("bigint").alias("artifact_size"), F.lit(None).cast("string").alias("checksum"),
        F.lit(None).cast("string").alias("artifact_key"),
        F.concat(F.lit("Failed to publish event: "), F.coalesce(F.col("error"), F.lit("error"))).alias("error_message"))
    orphans = err.where(F.col("artifact_key").isNotNull()).select("version_id", "artifact_key")
    return failed, orphans


RESULT_SCHEMA = "version_id string, seq bigint, result string, error string"
SETTLED = ("failed", "orphans")


def settle_batch(out: str, versions: DataFrame):
    """A foreachBatch function that settles publish results exactly once.

    A batch writes its FAILED events and orphaned keys to folders named by its id, replacing what a broken run of
    it left there, and then enters itself in the transaction table, one file for each batch, created only if
    absent. A replayed batch finds its entry and changes nothing; readers (``settled``) see entered batches only.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{out}/transactions/{batch_id:012d}.json"
        if path_exists(spark, entry):
            return
        for name, rows in zip(SETTLED, settle_publish(batch, versions)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        commits.create_if_absent(spark, entry, json.dumps({"batch": batch_id}))
    return run


def settled(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(FAILED lifecycle events, orphaned artifact keys) of the batches in the transaction table."""
    entered = spark.read.schema("batch long").json(f"{out}/transactions")
    return tuple(spark.read.parquet(f"{out}/{name}").join(entered, "batch", "left_semi").drop("batch") for name in SETTLED)


def reconcile_uploaded(versions: DataFrame, published: DataFrame) -> DataFrame:
    """UPLOADED versions whose event was never confirmed get it again;
    safe because the READY transition is idempotent."""
    return versions.where(F.col("status") == "UPLOADED").join(
        published.select("version_id"), "version_id", "left_anti")

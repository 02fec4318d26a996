"""Streaming lifecycle: stream equals batch, restarts, dead letters."""

import os

from pyspark.sql import functions as F

from lexidx.operators import catalog
from lexidx.plans import fixtures
from lexidx.streaming import events as ev
from tests.conftest import SF_SMALL


def _write_log(spark, log, path):
    (log.repartition(4, "version_id").sortWithinPartitions("version_id", "seq")
        .select(F.to_json(F.struct(*log.columns)).alias("value")).write.mode("append").text(path))


def _stream(spark, src, sink, ck):
    decoded = ev.decode(ev.read_raw(spark, "text", src), ev.LIFECYCLE_SCHEMA, "version_id")
    out = ev.apply_transitions(decoded.where(F.col("event").isNotNull()).select("event.*"))
    ev.run_available(out, sink, ck)


def test_stream_matches_batch_and_restarts(spark, tmp_dir):
    log = fixtures.lifecycle_events(spark, SF_SMALL)
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    _write_log(spark, log, src)
    _stream(spark, src, sink, ck)
    got = {(int(r.version_id), r.seq): r.outcome for r in spark.read.parquet(sink).collect()}
    want = {(r.version_id, r.seq): r.outcome for r in catalog.classify_events(log).collect()}
    assert got == want
    # A second run from the same checkpoint finds nothing new.
    _stream(spark, src, sink, ck)
    assert spark.read.parquet(sink).count() == len(want)
    # Re-delivered events meet the status alone: a second CREATED is a duplicate.
    _write_log(spark, log.where("version_id % 5 = 0 and kind = 'CREATED'"), src)
    _stream(spark, src, sink, ck)
    late = spark.read.parquet(sink).groupBy("version_id", "seq").agg(F.collect_list("outcome").alias("o"))
    again = [r.o for r in late.collect() if len(r.o) > 1]
    assert again and all("DUPLICATE" in o for o in again)


def test_poison_records_keep_their_text(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "dlt", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "part-0.txt"), "w") as f:
        f.write('{"versionId": "1", "indexId": "2", "versionNumber": 1}\n"just a string"\n{"indexId": "2"}\n')
    dl = ev.dead_letters(ev.decode(ev.read_raw(spark, "text", src), ev.UPLOADED_EVENT_SCHEMA, "versionId"))
    ev.run_available(dl, sink, ck)
    got = sorted((r.value, bytes(r.raw)) for r in spark.read.parquet(sink).collect())
    assert got == [('"just a string"', b'"just a string"'), ('{"indexId": "2"}', b'{"indexId": "2"}')]


def test_ready_listener_seeded_from_catalog(spark, tmp_dir):
    """READY for UPLOADED applies, for READY is a duplicate, for BUILT is
    stale, for an unknown version is not found (the reference's listener)."""
    versions = spark.createDataFrame(
        [(1, "UPLOADED", "1/1/index.tar.gz"), (2, "READY", "2/1/index.tar.gz"), (3, "BUILT", None)],
        "version_id bigint, status string, artifact_key string").select(
        "version_id", "status", F.lit(None).cast("bigint").alias("doc_count"),
        F.lit(None).cast("bigint").alias("artifact_size"), F.lit(None).cast("string").alias("checksum"),
        "artifact_key", F.lit(None).cast("string").alias("error_message"))
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "part-0.txt"), "w") as f:
        for i, vid in enumerate([1, 2, 3, 4, 1]):
            f.write(f'{{"versionId": "{vid}", "indexId": "9", "versionNumber": 1, '
                    f'"occurredAt": "2024-01-01T00:00:0{i}"}}\n')
    ready = ev.uploaded_to_ready(ev.decode(ev.read_raw(spark, "text", src), ev.UPLOADED_EVENT_SCHEMA, "versionId"))
    ev.run_available(ev.apply_transitions(ready, versions), sink, ck)
    got = sorted((r.version_id, r.outcome, r.status) for r in spark.read.parquet(sink).collect())
    assert got == [("1", "APPLIED", "READY"), ("1", "DUPLICATE", "READY"), ("2", "DUPLICATE", "READY"),
                   ("3", "STALE", "BUILT"), ("4", "NOT_FOUND", None)]


def test_event_sink_stream(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "part-0.txt"), "w") as f:
        f.write('{"versionId": "1", "indexId": "7", "versionNumber": 2}\n')
    decoded = ev.decode(ev.read_raw(spark, "text", src), ev.UPLOADED_EVENT_SCHEMA, "versionId")
    q = ev.publish_stream(ev.encode(decoded.select("event.*"), "indexId"), "text", out, ck)
    q.processAllAvailable()
    q.stop()
    rows = ev.from_lines(ev.read_raw(spark, "text", out, streaming=False)).collect()
    assert [(r.key, r.value) for r in rows] == [("7", '{"versionId":"1","indexId":"7","versionNumber":2}')]


def test_settle_publish_outcomes(spark):
    versions = spark.createDataFrame([(1, "UPLOADED", "a/1"), (2, "UPLOADED", "a/2"), (3, "UPLOADED", "a/3")],
                                     "version_id bigint, status string, artifact_key string")
    outcomes = spark.createDataFrame([(1, 10, "ACK", None), (2, 11, "TIMEOUT", None), (3, 12, "ERROR", "broker down")],
                                     "version_id bigint, seq bigint, result string, error string")
    failed, orphans = ev.settle_publish(outcomes, versions)
    assert [(r.version_id, r.seq, r.kind, r.error_message) for r in failed.collect()] == [
        (3, 12, "FAILED", "Failed to publish event: broker down")]
    assert [(r.version_id, r.artifact_key) for r in orphans.collect()] == [(3, "a/3")]
    # the timed-out version stays UPLOADED and is re-sent by the reconcile
    published = outcomes.where("result = 'ACK'").select("version_id")
    again = ev.reconcile_uploaded(versions.where("version_id <> 3"), published).collect()
    assert [r.version_id for r in again] == [2]


def test_state_keeps_counts_when_a_batch_mixes_nulls(spark, tmp_dir):
    """A BUILT count next to null counts in one micro-batch stays a long."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, 0, t0, "CREATED", None, None, None, None, None), (1, 1, t0, "BUILT", 7, 70, "c", None, None),
         (1, 2, t0, "UPLOADED", None, None, None, "k", None), (1, 3, t0, "READY", None, None, None, None, None)],
        ev.LIFECYCLE_SCHEMA)
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    _write_log(spark, log, src)
    _stream(spark, src, sink, ck)
    assert sorted((r.seq, r.outcome, r.status) for r in spark.read.parquet(sink).collect()) == [
        (0, "APPLIED", "CREATED"), (1, "APPLIED", "BUILT"), (2, "APPLIED", "UPLOADED"), (3, "APPLIED", "READY")]
    _write_log(spark, log.where("seq = 3"), src)  # redelivery reads the stored state back
    _stream(spark, src, sink, ck)
    assert spark.read.parquet(sink).where("seq = 3").count() == 2


def test_strict_decoding_and_keyed_files(spark, tmp_dir):
    """A badly typed record is a dead letter with its bytes; keys survive the file sink; ids may be UUIDs."""
    uid = "3f2b8c1e-0d54-4c0a-9a53-0b9c2e6f7a11"
    records = spark.createDataFrame(
        [("k1", f'{{"versionId": "{uid}", "versionNumber": 3, "occurredAt": "2024-05-01T00:00:00Z"}}'),
         ("k2", '{"versionId": "5", "versionNumber": "abc", "occurredAt": "notatime"}'), ("k3", "[1, 2]")],
        "key string, value string")
    src = os.path.join(tmp_dir, "src")
    ev.write_records(records, "text", src)
    back = ev.from_lines(ev.read_raw(spark, "text", src, streaming=False))
    decoded = ev.decode(back, ev.UPLOADED_EVENT_SCHEMA, "versionId")
    lost = {r.key: bytes(r.raw).decode() for r in ev.dead_letters(decoded).collect()}
    assert set(lost) == {"k2", "k3"} and lost["k2"].endswith('"notatime"}')
    ready = ev.uploaded_to_ready(decoded).collect()
    assert [(r.version_id, r.kind, r.key) for r in ready] == [(uid, "READY", "k1")]


def test_events_before_and_after_are_never_taken_for_duplicates(spark, tmp_dir):
    """Status alone decides: a late UPLOADED with a smaller seq applies, and a READY refused
    as stale or unknown applies when it comes again; unknown events keep their payload."""
    import datetime as dt
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))

    def feed(*steps):
        log = spark.createDataFrame([("v-1", seq, dt.datetime(2024, 1, 1), kind) + (None,) * 5 for seq, kind in steps],
                                    ev.LIFECYCLE_SCHEMA)
        ev.write_records(ev.encode(log, "version_id"), "text", src)
        records = ev.from_lines(ev.read_raw(spark, "text", src))
        decoded = ev.decode(records, ev.LIFECYCLE_SCHEMA, "version_id").where("event is not null")
        ev.run_available(ev.apply_transitions(decoded.select("event.*", "key", "raw")), sink, ck)
        return spark.read.parquet(sink)

    lost = ev.unknown_versions(feed((9, "READY"))).collect()
    assert [(r.key, r.reason) for r in lost] == [("v-1", "UNKNOWN_VERSION")] and '"kind":"READY"' in lost[0].value
    feed((1, "CREATED"), (2, "BUILT"), (5, "READY"))
    out = feed((3, "UPLOADED"), (5, "READY"))
    assert sorted((r.seq, r.outcome) for r in out.collect()) == [
        (1, "APPLIED"), (2, "APPLIED"), (3, "APPLIED"), (5, "APPLIED"), (5, "STALE"), (9, "NOT_FOUND")]


def test_hot_version_crosses_micro_batches_and_a_restart(spark, tmp_dir):
    """A third of the log is one version; files of 50 records, 3 a trigger: its state is carried over many batches."""
    log = fixtures.lifecycle_events(spark, SF_SMALL)
    log = log.withColumn("version_id", F.when(F.col("seq") % 3 == 0, F.lit(7)).otherwise(F.col("version_id")))
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    cut = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for part in (log.where(F.col("seq") < cut), log.where(F.col("seq") >= cut)):
        ev.write_log(part, "version_id", "seq", os.path.join(tmp_dir, "now"), records_per_file=50)
        os.makedirs(src, exist_ok=True)
        for name in sorted(os.listdir(os.path.join(tmp_dir, "now"))):
            if name.startswith("part-"):
                os.rename(os.path.join(tmp_dir, "now", name), os.path.join(src, f"{name}-{len(os.listdir(src)):05d}"))
        for name in os.listdir(os.path.join(tmp_dir, "now")):
            os.remove(os.path.join(tmp_dir, "now", name))
        os.rmdir(os.path.join(tmp_dir, "now"))
        records = ev.from_lines(ev.read_raw(spark, "text", src, {"maxFilesPerTrigger": "3"}))
        decoded = ev.decode(records, ev.LIFECYCLE_SCHEMA, "version_id")
        q = ev.run_available(ev.apply_transitions(decoded.where(F.col("event").isNotNull()).select("event.*")), sink, ck)
        assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 3
    rows = spark.read.parquet(sink).collect()
    want = {(r.version_id, r.seq): r.outcome for r in catalog.classify_events(log).collect()}
    assert {(int(r.version_id), r.seq): r.outcome for r in rows} == want and len(rows) == len(want)


def test_log_files_are_ordered_and_bounded(spark, tmp_dir):
    log = fixtures.lifecycle_events(spark, SF_SMALL)
    ev.write_log(log, "version_id", "seq", os.path.join(tmp_dir, "log"), records_per_file=100)
    files = [os.path.join(tmp_dir, "log", n) for n in os.listdir(os.path.join(tmp_dir, "log")) if n.startswith("part-")]
    files.sort(key=os.path.getmtime)
    seqs = []
    for f in files:
        found = [r.seq for r in ev.decode(ev.from_lines(ev.read_raw(spark, "text", f, streaming=False)), ev.LIFECYCLE_SCHEMA, "version_id").select("event.seq").collect()]
        assert 0 < len(found) <= 100
        seqs += found
    assert seqs == sorted(seqs) and len(seqs) == log.count()


def test_settling_publish_results_is_exactly_once(spark, tmp_dir, monkeypatch):
    versions = spark.createDataFrame([(str(i), "UPLOADED", f"a/{i}") for i in range(6)], "version_id string, status string, artifact_key string")
    rows = [("0", 1, "ACK", None), ("1", 2, "TIMEOUT", None), ("2", 3, "ERROR", "refused"), ("3", 4, "ERROR", None)]
    first = spark.createDataFrame(rows, ev.RESULT_SCHEMA)
    run = ev.settle_batch(tmp_dir, versions)

    def state():
        failed, orphans = ev.settled(spark, tmp_dir)
        return (sorted((r.version_id, r.seq, r.error_message) for r in failed.collect()),
                sorted((r.version_id, r.artifact_key) for r in orphans.collect()))
    want = ([("2", 3, "Failed to publish event: refused"), ("3", 4, "Failed to publish event: error")], [("2", "a/2"), ("3", "a/3")])
    # A run that breaks after its writes leaves nothing that readers see; its replay settles the batch.
    with monkeypatch.context() as m:
        m.setattr(ev.commits, "create_if_absent", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            run(first, 0)
        except RuntimeError:
            pass
    os.makedirs(os.path.join(tmp_dir, "transactions"))
    assert state() == ([], [])
    run(first, 0)
    assert state() == want
    run(spark.createDataFrame([("5", 9, "ERROR", "again")], ev.RESULT_SCHEMA), 0)  # a replayed batch changes nothing
    assert state() == want
    run(spark.createDataFrame([("4", 5, "ERROR", "later")], ev.RESULT_SCHEMA), 1)
    assert [k for _, k in state()[1]] == ["a/2", "a/3", "a/4"]


def test_state_is_kept_for_buckets_of_versions(spark, tmp_dir):
    """3,000 versions come back in two micro-batches: the keyed step has a group for each bucket, not for each version."""
    import datetime as dt
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    log = spark.range(3000).select(
        F.concat(F.lit("v"), "id").alias("version_id"), F.col("id").alias("seq"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"),
        F.explode(F.array(F.lit("CREATED"), F.lit("UPLOADED"))).alias("kind"), F.when(F.col("id") % 2 == 0, F.lit(2**60 + 1)).alias("doc_count"),
        F.lit(None).cast("bigint").alias("artifact_size"), *[F.lit(None).cast("string").alias(c) for c in ("checksum", "artifact_key", "error_message")])
    log = log.withColumn("seq", F.when(F.col("kind") == "CREATED", F.col("seq")).otherwise(F.col("seq") + 3000))
    groups = []
    for kind in ("CREATED", "UPLOADED", "READY"):
        part = (log.where(F.col("kind") == kind) if kind != "READY" else
                log.where("kind = 'UPLOADED' and seq % 3 = 0").withColumns({"kind": F.lit(kind), "seq": F.col("seq") + 3000}))
        _write_log(spark, part, src)
        decoded = ev.decode(ev.read_raw(spark, "text", src), ev.LIFECYCLE_SCHEMA, "version_id").where("event is not null")
        q = ev.run_available(ev.apply_transitions(decoded.select("event.*")), sink, ck)
        groups += [s["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"] for s in p["stateOperators"]]
    assert 0 < max(groups) <= ev.STATE_BUCKETS < 3000
    got = spark.read.parquet(sink).groupBy("version_id").agg(F.max_by("status", "seq").alias("status"), F.collect_set("outcome").alias("o")).collect()
    assert len(got) == 3000 and all(r.o == ["APPLIED"] for r in got)
    assert sum(r.status == "READY" for r in got) == 1000 and sum(r.status == "UPLOADED" for r in got) == 2000


def test_bucket_state_reads_back_whole():
    """Null ids beside the text "null", longs beyond 2**53, text with quotes and line ends."""
    from types import SimpleNamespace
    built = dict(kind="BUILT", ts=5, doc_count=str(2**60 + 1), artifact_size=None, checksum='a"\nü', artifact_key=None, error_message=None)
    st = ev._step(ev._step(None, SimpleNamespace(kind="CREATED", ts=4.0))[0], SimpleNamespace(**built))[0]
    state = SimpleNamespace(exists=True, get=(ev._packed({None: st, "null": st | {"status": "READY"}, "7": st}),))
    rows = ev._rows(state)
    assert list(rows) == [None, "null", "7"] and rows["null"][0] == "READY"
    assert rows["7"] == ["BUILT", 2**60 + 1, None, 'a"\nü', None, None, 2, 4, 5] and ev._packed(rows) == state.get[0]

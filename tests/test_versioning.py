"""End to end: NDJSON -> published version -> lifecycle events -> fold."""

import datetime as dt
import glob

from lexidx.operators import artifact, catalog, versioning
from lexidx.operators.schema import fields_of
from lexidx.streaming.events import LIFECYCLE_SCHEMA
from tests.conftest import write_lines

F6 = fields_of([("title", "text"), ("tag", "keyword"), ("count", "long")])


def _log(spark, vid, kinds_before, events, kinds_after=()):
    t0 = dt.datetime(2024, 1, 1)
    head = spark.createDataFrame([(vid, -10 + i, t0, k, None, None, None, None, None)
                                  for i, k in enumerate(kinds_before)], LIFECYCLE_SCHEMA)
    tail = spark.createDataFrame([(vid, 100 + i, t0, k, None, None, None, None, None)
                                  for i, k in enumerate(kinds_after)], LIFECYCLE_SCHEMA)
    return head.unionByName(events).unionByName(tail)


GOOD = ['{"title": "river stones", "tag": "geo", "count": 12}', '{"title": "cold rain", "tag": "sky", "count": 30}']
UID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def _row(spark, state, version):
    return spark.createDataFrame([("idx", version, state.status, state.doc_count)],
                                 "index_id string, version int, status string, doc_count bigint")


def test_build_ready_end_to_end(spark, tmp_dir):
    src = write_lines(tmp_dir, GOOD)
    ev = versioning.build_version(spark, src, F6, f"{tmp_dir}/store", "idx", 1, version_id=UID)
    kinds = [r.kind for r in ev.orderBy("seq").collect()]
    assert kinds == ["CREATED", "BUILDING", "BUILT", "UPLOADED"]
    state = catalog.fold_versions(_log(spark, UID, [], ev, ["READY"])).collect()[0]
    assert (state.version_id, state.status, state.doc_count) == (UID, "READY", 2)
    assert state.artifact_key == "index_id=idx/version=1"
    loaded = artifact.load_version(spark, f"{tmp_dir}/store", "idx", 1, _row(spark, state, 1)).collect()[0]
    assert loaded.state == "LOADED" and loaded.num_docs == 2


def test_build_fails_on_bad_line(spark, tmp_dir):
    src = write_lines(tmp_dir, [GOOD[0], '{"title": "warm wind", "colour": "red"}'])
    ev = versioning.build_version(spark, src, F6, f"{tmp_dir}/store", "idx", 2, version_id=UID, created=False)
    rows = ev.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["BUILDING", "FAILED"]
    assert rows[1].error_message == "Line 2: unknown field 'colour'"
    state = catalog.fold_versions(_log(spark, UID, ["CREATED"], ev)).collect()[0]
    assert (state.status, state.doc_count, state.artifact_key, state.checksum) == ("FAILED", None, None, None)
    assert not glob.glob(f"{tmp_dir}/store/index_id=idx/version=2/data-*")  # nothing of the attempt is left
    gone = artifact.load_version(spark, f"{tmp_dir}/store", "idx", 2, _row(spark, state, 2)).collect()[0]
    assert gone.state == "FAILED"


def test_every_other_failure_is_an_event_too(spark, tmp_dir, monkeypatch):
    ev = versioning.build_version(spark, f"{tmp_dir}/nowhere", F6, f"{tmp_dir}/store", "idx", 3, version_id=UID)
    last = ev.orderBy("seq").collect()[-1]
    assert last.kind == "FAILED" and "PATH_NOT_FOUND" in last.error_message
    from lexidx.operators import index
    monkeypatch.setattr(index, "verify_counts", lambda e, f: (_ for _ in ()).throw(index.IndexVerificationError()))
    ev = versioning.build_version(spark, write_lines(tmp_dir, GOOD), F6, f"{tmp_dir}/store", "idx", 4, version_id=UID)
    last = ev.orderBy("seq").collect()[-1]
    assert (last.kind, last.error_message) == ("FAILED", "IndexVerificationError")
    assert not glob.glob(f"{tmp_dir}/store/index_id=idx/version=4/data-*")


def test_build_refused_while_another_build_is_active(spark, tmp_dir):
    import pytest
    src = write_lines(tmp_dir, ['{"title": "x"}'])
    versions = spark.createDataFrame([(7, 1, "BUILDING"), (8, 2, "READY")],
                                     "index_id bigint, version int, status string")
    with pytest.raises(versioning.BuildConflict, match="Index 7 already has an active build"):
        versioning.build_version(spark, src, F6, f"{tmp_dir}/store", 7, 2, version_id=70, versions=versions)
    ev = versioning.build_version(spark, src, F6, f"{tmp_dir}/store", 8, 3, version_id=80, versions=versions)
    assert [r.kind for r in ev.orderBy("seq").collect()][-1] == "UPLOADED"


def test_build_publish_listen_ready(spark, tmp_dir):
    """The whole flow: build -> uploaded event on the topic -> listener -> READY."""
    import os

    from lexidx.streaming import events as ev
    src = write_lines(tmp_dir, GOOD)
    log = versioning.build_version(spark, src, F6, f"{tmp_dir}/store", "idx", 1, version_id=UID)
    topic = os.path.join(tmp_dir, "topic")
    ev.write_records(ev.encode(versioning.uploaded_events(log, "idx", 1), "indexId"), "text", topic)
    current = catalog.fold_versions(log)            # the catalog row: UPLOADED
    decoded = ev.decode(ev.from_lines(ev.read_raw(spark, "text", topic)), ev.UPLOADED_EVENT_SCHEMA, "versionId")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    ev.run_available(ev.apply_transitions(ev.uploaded_to_ready(decoded), current), out, ck)
    got = spark.read.parquet(out).collect()
    assert [(r.version_id, r.outcome, r.status) for r in got] == [(UID, "APPLIED", "READY")]
    # a second delivery of the same event is a duplicate
    ev.write_records(ev.encode(versioning.uploaded_events(log, "idx", 1), "indexId"), "text", topic)
    ev.run_available(ev.apply_transitions(ev.uploaded_to_ready(decoded), current), out, ck)
    outcomes = sorted(r.outcome for r in spark.read.parquet(out).collect())
    assert outcomes == ["APPLIED", "DUPLICATE"]

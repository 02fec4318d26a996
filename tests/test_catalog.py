"""Catalog requests and the lifecycle fold (batch and its rules)."""

import datetime as dt

from lexidx.operators import catalog, schema
from lexidx.operators.schema import FIELDS_TYPE


def _versions(spark, rows):
    return spark.createDataFrame(
        [(vid, idx, v, st, None, None, None, None) for vid, idx, v, st in rows],
        "version_id bigint, index_id bigint, version int, status string, doc_count bigint, "
        "artifact_size bigint, checksum string, artifact_key string")


def test_versions_listed_descending_and_next_version(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "index_id bigint, name string")
    v = _versions(spark, [(31, 1, 4, "FAILED"), (30, 1, 2, "READY"), (33, 1, 7, "CREATED"), (40, 3, 5, "UPLOADED")])
    req = spark.createDataFrame([(1,), (8,)], "index_id bigint")
    rows = catalog.list_versions(req, cat, v).collect()
    assert [(r.index_id, r.version) for r in rows if r.error is None] == [(1, 7), (1, 4), (1, 2)]
    assert [r.error for r in rows if r.error] == ["Index 8 not found"]
    nv = {r.index_id: r.next_version for r in catalog.next_version(cat, v).collect()}
    assert nv == {1: 8, 2: 1, 3: 6}


def test_register_refuses_existing_and_repeated_names(spark):
    cat = spark.createDataFrame([(1, "taken")], "index_id bigint, name string")
    batch = spark.createDataFrame([(1, "taken"), (2, "new"), (3, "new")], "req_id bigint, name string")
    got = {r.req_id: (r.status, r.message) for r in catalog.register_indexes(batch, cat).collect()}
    assert got[1] == ("REFUSED", "Index with name 'taken' already exists")
    assert got[2] == ("ACCEPTED", None) and got[3][0] == "REFUSED"


def test_artifact_gate_and_active_builds(spark):
    v = _versions(spark, [(1, 7, 1, "BUILT"), (2, 7, 2, "BUILDING"), (3, 8, 1, "UPLOADED")])
    res = spark.createDataFrame([(1, 7, 1, "FOUND", "BUILT", None), (2, 8, 1, "FOUND", "UPLOADED", "8/1/index.tar.gz")],
                                "req_id bigint, index_id bigint, version int, resolution string, status string, artifact_key string")
    got = {r.req_id: r for r in catalog.artifact_gate(res).collect()}
    assert got[1].message == "Artifact for version 1 of index 7 is not available (status=BUILT)"
    assert got[2].artifact_key == "8/1/index.tar.gz"
    act = {r.index_id: r.message for r in catalog.active_builds(v).collect()}
    assert act[7] == "Index 7 already has an active build" and act[8] is None


def _events(spark, kinds):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(1, i, t0 + dt.timedelta(minutes=i), k, 5, 50, "c", "k", f"err {i}") for i, k in enumerate(kinds)],
        "version_id bigint, seq bigint, ts timestamp, kind string, doc_count bigint, artifact_size bigint, "
        "checksum string, artifact_key string, error_message string")


def test_fold_rules(spark):
    # FAILED after READY is ignored; a repeated READY is a duplicate.
    out = {r.seq: r.outcome for r in catalog.classify_events(
        _events(spark, ["CREATED", "BUILDING", "BUILT", "UPLOADED", "READY", "FAILED", "READY"])).collect()}
    assert out == {0: "APPLIED", 1: "APPLIED", 2: "APPLIED", 3: "APPLIED", 4: "APPLIED", 5: "STALE", 6: "DUPLICATE"}
    f = catalog.fold_versions(_events(spark, ["CREATED", "BUILT", "UPLOADED", "READY", "FAILED"])).collect()[0]
    assert f.status == "READY" and f.artifact_key == "k" and f.doc_count == 5
    # FAILED after UPLOADED clears the artifact; a later READY is stale.
    f = catalog.fold_versions(_events(spark, ["CREATED", "BUILT", "UPLOADED", "FAILED", "READY"])).collect()[0]
    assert (f.status, f.artifact_key, f.doc_count, f.error_message) == ("FAILED", None, None, "err 3")
    assert f.applied_events == 4
    # Events before the version exists are not found.
    out = {r.seq: r.outcome for r in catalog.classify_events(_events(spark, ["UPLOADED", "CREATED", "READY"])).collect()}
    assert out == {0: "NOT_FOUND", 1: "APPLIED", 2: "STALE"}


def test_definition_audit_rules(spark):
    defs = spark.createDataFrame([
        (1, "good_name", "d", [("title", "text")]),
        (2, "Tall Ship", "d", [("title", "text")]),
        (3, "", "d", [("title", "text")]),
        (4, "x", "d", []),
        (5, "y", "d", [("a", "text"), ("a", "long")]),
        (6, "z", "d", [("a", "bogus")]),
    ], schema=f"index_id bigint, name string, description string, fields {FIELDS_TYPE.simpleString()}")
    got = sorted((r.index_id, r.rule) for r in schema.definition_audit(defs).collect())
    assert got == [(2, "NAME_PATTERN"), (3, "NAME_BLANK"), (4, "NO_FIELDS"), (5, "DUPLICATE_FIELD_NAMES"),
                   (6, "FIELD_TYPE_UNKNOWN")]


def test_fold_hot_version_matches_sequential_replay(spark):
    """One version holds most events and spans many range partitions."""
    import random
    from types import SimpleNamespace

    from lexidx.streaming.events import _step
    rnd = random.Random(7)
    kinds = ["CREATED", "BUILDING", "BUILT", "UPLOADED", "READY", "FAILED"]
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for vid, n in [(1, 4000), (2, 50), (3, 50)]:
        for i in range(n):
            rows.append((vid, vid * 100000 + i * 997, t0 + dt.timedelta(seconds=i), rnd.choice(kinds), i, i, "c", "k", "e"))
    ev = spark.createDataFrame(rows, "version_id bigint, seq bigint, ts timestamp, kind string, doc_count bigint, "
                                     "artifact_size bigint, checksum string, artifact_key string, error_message string")
    got = {(r.version_id, r.seq): r.outcome for r in catalog.classify_events(ev).collect()}
    want, state = {}, {}
    for r in rows:
        e = SimpleNamespace(kind=r[3], ts=r[2], doc_count=r[4], artifact_size=r[5], checksum=r[6],
                            artifact_key=r[7], error_message=r[8])
        state[r[0]], want[(r[0], r[1])] = _step(state.get(r[0]), e)
    assert got == want


def test_constraint_breaches_and_cascade(spark):
    cat = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "index_id bigint, name string")
    v = _versions(spark, [(10, 1, 1, "BUILT"), (11, 1, 1, "READY"), (12, 3, 1, "BUILDING"),
                          (13, 3, 2, "CREATED"), (14, 9, 1, "READY")])
    got = sorted((r.rule, r.subject, r.n) for r in catalog.constraint_audit(cat, v).collect())
    assert got == [("DUPLICATE_NAME", "same", 2), ("DUPLICATE_VERSION", "1:1", 2),
                   ("MULTIPLE_ACTIVE_BUILDS", "3", 2)]
    deleted = spark.createDataFrame([(1,)], "index_id bigint")
    cat2, ver2 = catalog.cascade_delete(cat, v, deleted)
    assert sorted(r.index_id for r in cat2.collect()) == [2, 3]
    # versions of the deleted index and the orphan (index 9) are gone
    assert sorted(r.version_id for r in ver2.collect()) == [12, 13]


def test_resolve_tells_missing_index_from_missing_version(spark):
    cat = spark.createDataFrame([(1, "a")], "index_id bigint, name string")
    v = _versions(spark, [(10, 1, 1, "READY")])
    req = spark.createDataFrame([(1, 1, 1), (2, 1, 5), (3, 7, 1)], "req_id bigint, index_id bigint, version int")
    got = {r.req_id: (r.resolution, r.message) for r in catalog.resolve_versions(req, cat, v).collect()}
    assert got == {1: ("FOUND", None), 2: ("VERSION_NOT_FOUND", "Version 5 not found for index 1"),
                   3: ("INDEX_NOT_FOUND", "Index 7 not found")}


def test_lookup_by_id_and_by_name(spark):
    cat = spark.createDataFrame([(1, "alpha"), (2, "beta")], "index_id bigint, name string")
    by_id = spark.createDataFrame([(10, 2), (11, 5)], "req_id bigint, index_id bigint")
    got = {r.req_id: (r.name, r.status, r.message) for r in catalog.lookup_indexes(by_id, cat).collect()}
    assert got == {10: ("beta", "FOUND", None), 11: (None, "NOT_FOUND", "Index 5 not found")}
    by_name = spark.createDataFrame([(20, "alpha"), (21, "gamma")], "req_id bigint, name string")
    got = {r.req_id: (r.index_id, r.status) for r in catalog.lookup_indexes(by_name, cat, by="name").collect()}
    assert got == {20: (1, "FOUND"), 21: (None, "NOT_FOUND")}


def test_definition_length_rules_and_roundtrip_order(spark):
    from pyspark.sql import functions as F
    long_name, long_desc = "x" * 65, "d" * 513
    defs = spark.createDataFrame([
        (1, long_name, "d", [("title", "text")]),
        (2, "ok", long_desc, [("title", "text")]),
        (3, "ok2", "d", [(" ", "text"), ("f" * 65, "long"), ("g", None)]),
    ], schema=f"index_id bigint, name string, description string, fields {FIELDS_TYPE.simpleString()}")
    got = sorted((r.index_id, r.rule) for r in schema.definition_audit(defs).collect())
    assert got == [(1, "NAME_TOO_LONG"), (2, "DESCRIPTION_TOO_LONG"), (3, "FIELD_NAME_BLANK"),
                   (3, "FIELD_NAME_TOO_LONG"), (3, "FIELD_TYPE_MISSING")]
    fl = spark.createDataFrame([([("z", "TEXT"), ("a", "Long"), ("m", "keyword")],)],
                               f"fields {FIELDS_TYPE.simpleString()}")
    back = fl.select(schema.map_to_fields(schema.fields_to_map(F.col("fields"))).alias("f")).collect()[0].f
    assert [(x.name, x.type) for x in back] == [("z", "text"), ("a", "long"), ("m", "keyword")]

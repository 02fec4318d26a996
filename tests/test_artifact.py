"""Manifest, integrity, publish/load and the archive audit."""

import glob
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lexidx.operators import artifact, commits, index
from lexidx.operators.schema import fields_of
from lexidx.plans import tables
from lexidx.sources.files import list_objects
from tests.conftest import SF_SMALL


def test_manifest_matches_hashlib(spark):
    man = {r.path: (r.length, r.sha256) for r in artifact.manifest(
        list_objects(spark, SF_SMALL, "*.parquet").withColumn("path", F.col("name"))).collect()}
    for f in glob.glob(f"{SF_SMALL}/*.parquet"):
        data = open(f, "rb").read()
        assert man[os.path.basename(f)] == (len(data), hashlib.sha256(data).hexdigest())


def _versions(spark, status, count, index_id="docs", version=1):
    return spark.createDataFrame([(index_id, version, status, count)],
                                 "index_id string, version int, status string, doc_count bigint")


def _load(spark, root, status, count, version=1, **kw):
    return artifact.load_version(spark, root, "docs", version, _versions(spark, status, count, version=version), **kw).collect()[0]


def _publish(spark, root, version=1, docs=None, fields=tables.DOCUMENT_FIELDS):
    docs = tables.documents_index_input(spark, SF_SMALL) if docs is None else docs
    return artifact.publish_version(spark, docs, fields, root, "docs", version).collect()[0]


def test_publish_load_and_tamper(spark, tmp_dir):
    ev = _publish(spark, tmp_dir)
    assert ev.doc_count == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() and len(ev.checksum) == 64
    ok = _load(spark, tmp_dir, "READY", ev.doc_count, register_as="t1")
    assert ok.state == "LOADED" and ok.num_docs == ev.doc_count
    assert spark.sql("select count(*) from t1_stored").collect()[0][0] == ev.doc_count
    assert spark.sql("select doc_count from t1_field_stats").collect()[0][0] > 0 and spark.table("t1_terms").count() > 0
    gate = _load(spark, tmp_dir, "BUILT", ev.doc_count)
    assert gate.state == "FAILED" and "status=BUILT" in gate.error
    count = _load(spark, tmp_dir, "READY", ev.doc_count + 1)
    assert count.error == f"Loaded index doc count mismatch: expected {ev.doc_count + 1} but found {ev.doc_count}"
    unknown = artifact.load_version(spark, tmp_dir, "docs", 8, _versions(spark, "READY", 1)).collect()[0]
    assert unknown.state == "FAILED" and "not found" in unknown.error
    victim = sorted(glob.glob(f"{tmp_dir}/index_id=docs/version=1/data-*/stored/*.parquet"))[0]
    with open(victim, "ab") as f:
        f.write(b"x")
    crc = os.path.join(os.path.dirname(victim), "." + os.path.basename(victim) + ".crc")
    if os.path.exists(crc):  # object stores keep no local checksum file
        os.remove(crc)
    bad = _load(spark, tmp_dir, "READY", ev.doc_count)
    assert bad.state == "FAILED" and bad.error.startswith("Downloaded artifact integrity check failed")


def test_extra_files_hidden_folders_and_broken_tables_fail_the_load(spark, tmp_dir):
    ev = _publish(spark, tmp_dir)
    (data,) = glob.glob(f"{tmp_dir}/index_id=docs/version=1/data-*")
    os.makedirs(f"{data}/stored/_hidden")
    with open(f"{data}/stored/_hidden/x.parquet", "wb") as f:  # no reader ever sees it
        f.write(b"junk")
    assert _load(spark, tmp_dir, "READY", ev.doc_count).state == "LOADED"
    with open(f"{data}/stored/notes.txt", "w") as f:
        f.write("not part of the version")
    extra = _load(spark, tmp_dir, "READY", ev.doc_count)
    assert extra.state == "FAILED" and "notes.txt: EXTRA" in extra.error
    os.remove(f"{data}/stored/notes.txt")
    for f in glob.glob(f"{data}/terms/*.parquet"):
        os.remove(f)
    assert "MISSING" in _load(spark, tmp_dir, "READY", ev.doc_count).error


def test_republishing_leaves_nothing_of_the_attempt_before(spark, tmp_dir):
    both = spark.createDataFrame([(1, 5, 2.5), (2, 6, None)], "doc_id bigint, a bigint, b double")
    _publish(spark, tmp_dir, docs=both, fields=fields_of([("a", "long"), ("b", "double")]))
    ev = _publish(spark, tmp_dir, docs=both.select("doc_id", "a"), fields=fields_of([("a", "long")]))
    path = f"{tmp_dir}/index_id=docs/version=1"
    assert len(glob.glob(f"{path}/data-*")) == 2  # its readers may still be at work
    assert len(commits.expire(spark, path, retention=0)) == 1 and len(glob.glob(f"{path}/data-*")) == 1
    assert _load(spark, tmp_dir, "READY", ev.doc_count).state == "LOADED"
    t = index.read(spark, artifact.data_path(spark, tmp_dir, "docs", 1))
    assert t.double_points is None and t.postings is None  # an index of one number field has no terms
    assert sorted((r.value, r.doc_id) for r in t.long_points.collect()) == [(5, 1), (6, 2)]


def test_a_moved_root_with_odd_characters_still_verifies(spark, tmp_dir):
    odd = f"{tmp_dir}/a (b)+c"
    ev = _publish(spark, odd)
    assert all(r.path.startswith("data-") for r in spark.read.parquet(f"{odd}/index_id=docs/version=1/_manifest").collect())
    shutil.copytree(odd, f"{tmp_dir}/elsewhere")
    assert _load(spark, f"{tmp_dir}/elsewhere", "READY", ev.doc_count).state == "LOADED"


def test_failed_publish_keeps_the_version_before_and_removes_its_own_files(spark, tmp_dir):
    ev = _publish(spark, tmp_dir)

    def fail():
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        artifact.publish_version(spark, tables.documents_index_input(spark, SF_SMALL), tables.DOCUMENT_FIELDS, tmp_dir,
                                 "docs", 1, after_stored=fail)
    assert len(glob.glob(f"{tmp_dir}/index_id=docs/version=1/data-*")) == 1
    assert _load(spark, tmp_dir, "READY", ev.doc_count).state == "LOADED"


def test_archive_audit(spark):
    rows = [("fine", 0, "notes", "directory", 0), ("fine", 1, "notes/one.md", "file", 4), ("fine", 2, "./two.md", "file", 6),
            ("climbs", 0, "in.md", "file", 5), ("climbs", 1, "../out.md", "file", 5), ("climbs", 2, "p/../../q", "file", 5),
            ("linked", 0, "shortcut", "symlink", 0), ("rooted", 0, "/var/x", "file", 5), ("queue", 0, "pipe", "other", 0)]
    entries = spark.createDataFrame(rows, "archive string, position int, entry string, entry_type string, size bigint")
    out = artifact.audit_entries(entries).collect()
    got = {(r.archive, r.entry): (r.verdict, r.message) for r in out}
    assert got[("fine", "notes/one.md")] == ("OK", None) and got[("fine", "./two.md")][0] == "OK"
    assert got[("climbs", "../out.md")] == (
        "OUTSIDE_TARGET", "Refusing to extract tar entry outside target directory: '../out.md'")
    assert got[("climbs", "p/../../q")][0] == got[("rooted", "/var/x")][0] == "OUTSIDE_TARGET"
    assert got[("linked", "shortcut")] == ("LINK", "Refusing to extract link tar entry 'shortcut'")
    assert got[("queue", "pipe")][0] == "UNSUPPORTED"
    assert {(r.archive, r.position) for r in out if r.first_failure} == {("climbs", 1), ("linked", 0), ("rooted", 0), ("queue", 0)}
    sizes = {r.archive: r.total_bytes for r in artifact.unpacked_size(entries).collect()}
    assert sizes["fine"] == 10 and sizes["linked"] == 0

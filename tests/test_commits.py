"""Concurrent publishers, pinned readers, retention, and the sweep of orphans."""

import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexidx.operators import artifact, commits, index, sweep
from lexidx.operators.schema import fields_of

FIELDS = fields_of([("a", "long")])


def _docs(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, a bigint")


def _publish(spark, root, *values, version=1, **kw):
    return artifact.publish_version(spark, _docs(spark, *values), FIELDS, root, "docs", version, **kw).first()


def _values(spark, root, version=1):
    return sorted(r.a for r in index.read(spark, artifact.data_path(spark, root, "docs", version)).stored.collect())


def _versions(spark, *rows):
    return spark.createDataFrame([("docs", v, s, n, f"index_id=docs/version={v}") for v, s, n in rows],
                                 "index_id string, version int, status string, doc_count bigint, artifact_key string")


def test_one_of_many_creators_wins(spark, tmp_dir):
    won = []
    start = threading.Barrier(8)

    def create(i):
        start.wait()
        if commits.create_if_absent(spark, f"{tmp_dir}/log/1.json", f"writer {i}"):
            won.append(i)
    threads = [threading.Thread(target=create, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(f"{tmp_dir}/log/1.json").read() == f"writer {won[0]}"
    assert os.listdir(f"{tmp_dir}/log") == ["1.json"]


def test_two_publishers_end_with_one_winner_and_one_clean_error(spark, tmp_dir):
    """The second one starts and commits while the first is writing."""
    with pytest.raises(commits.PublishConflict, match="another writer"):
        _publish(spark, tmp_dir, 1, 2, after_stored=lambda: _publish(spark, tmp_dir, 7, 8, 9))
    path = f"{tmp_dir}/index_id=docs/version=1"
    assert _values(spark, tmp_dir) == [7, 8, 9]
    (won,) = commits.log(spark, path)
    assert [os.path.basename(p) for p in glob.glob(f"{path}/data-*")] == [won.attempt]
    assert [os.path.basename(p) for p in glob.glob(f"{path}/_manifest/*")] == [f"attempt={won.attempt}"]
    assert _publish(spark, tmp_dir, 4).doc_count == 1 and _values(spark, tmp_dir) == [4]


def test_publishers_in_threads(spark, tmp_dir):
    results = []

    def run(i):
        try:
            results.append(("won", i, _publish(spark, tmp_dir, *range(i + 1)).doc_count))
        except commits.PublishConflict:
            results.append(("lost", i, None))
    threads = [threading.Thread(target=run, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = commits.log(spark, f"{tmp_dir}/index_id=docs/version=1")
    assert len(results) == 3 and [c.number for c in log] == list(range(1, len(log) + 1))
    assert len(log) == sum(r[0] == "won" for r in results) >= 1
    assert len(glob.glob(f"{tmp_dir}/index_id=docs/version=1/data-*")) == len(log)
    assert len(_values(spark, tmp_dir)) == log[-1].doc_count


def test_a_reader_opened_before_a_republish_still_reads(spark, tmp_dir):
    _publish(spark, tmp_dir, 1, 2, 3)
    reader = index.read(spark, artifact.data_path(spark, tmp_dir, "docs", 1))
    _publish(spark, tmp_dir, 4)
    assert sorted(r.a for r in reader.stored.collect()) == [1, 2, 3] and _values(spark, tmp_dir) == [4]
    path = f"{tmp_dir}/index_id=docs/version=1"
    first, second = commits.log(spark, path)
    assert commits.expire(spark, path, retention=60, now=second.committed_at + 59) == []
    assert commits.expire(spark, path, retention=60, now=second.committed_at + 61) == [first.attempt]
    assert _values(spark, tmp_dir) == [4] and not os.path.exists(f"{path}/{first.attempt}")
    assert commits.expire(spark, path, retention=0) == []


def test_a_version_without_commit_is_not_there(spark, tmp_dir):
    with pytest.raises(RuntimeError):
        _publish(spark, tmp_dir, 1, after_stored=lambda: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(FileNotFoundError):
        artifact.data_path(spark, tmp_dir, "docs", 1)
    row = artifact.load_version(spark, tmp_dir, "docs", 1, _versions(spark, (1, "READY", 1))).first()
    assert row.state == "FAILED" and "manifest missing" in row.error


def test_sweep_finds_orphans_and_spares_running_attempts(spark, tmp_dir):
    for v in (1, 2, 3):
        _publish(spark, tmp_dir, v, v, version=v)
    _publish(spark, tmp_dir, 9, version=3)  # replaced, not yet expired
    planted = f"{tmp_dir}/index_id=gone/version=4/data-lost/stored"
    crashed = f"{tmp_dir}/index_id=docs/version=1/data-crashed/stored"
    running = f"{tmp_dir}/index_id=docs/version=1/data-running/stored"
    for folder in (planted, crashed, running):
        os.makedirs(folder)
        with open(f"{folder}/part-0.parquet", "w") as f:
            f.write("x")
    long_ago = time.time() - 10_000
    for f in glob.glob(f"{tmp_dir}/**/*", recursive=True):
        if "running" not in f:
            os.utime(f, (long_ago, long_ago))
    versions = _versions(spark, (1, "READY", 2), (2, "FAILED", None), (3, "UPLOADED", 1))
    found = sweep.orphaned_attempts(spark, tmp_dir, versions, grace_seconds=3600)
    replaced, live = [c.attempt for c in commits.log(spark, f"{tmp_dir}/index_id=docs/version=3")]
    (failed,) = commits.log(spark, f"{tmp_dir}/index_id=docs/version=2")
    assert {(r.folder, r.reason) for r in found.collect()} == {
        ("index_id=gone/version=4/data-lost", "NO_VERSION"), ("index_id=docs/version=1/data-crashed", "UNCOMMITTED"),
        (f"index_id=docs/version=2/{failed.attempt}", "NO_VERSION"), (f"index_id=docs/version=3/{replaced}", "SUPERSEDED")}
    assert sweep.sweep(spark, tmp_dir, found) == 4
    assert not os.path.exists(planted) and not os.path.exists(crashed) and os.path.exists(running)
    assert _values(spark, tmp_dir) == [1, 1] and _values(spark, tmp_dir, 3) == [9]
    later = sweep.orphaned_attempts(spark, tmp_dir, versions, grace_seconds=0)
    assert [(r.folder, r.reason) for r in later.collect()] == [("index_id=docs/version=1/data-running", "UNCOMMITTED")]


def test_listing_reads_no_content(spark, tmp_dir):
    _publish(spark, tmp_dir, 1)
    plan = sweep.stored_folders(sweep.list_files(spark, tmp_dir), sweep.ATTEMPT_FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    row = sweep.stored_folders(sweep.list_files(spark, tmp_dir), sweep.ATTEMPT_FOLDER).where(F.col("artifact_key") == "index_id=docs/version=1").first()
    assert row.files >= 2 and row.bytes > 0

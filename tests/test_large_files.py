"""Files beyond what one row can hold are hashed in pieces."""

import gzip
import hashlib
import os
import random

import pytest

from lexidx.operators import artifact
from lexidx.plans import artifact_queries
from lexidx.sources import files
from lexidx.sources.files import hashed_objects

LARGE = (1 << 31) + 12_345  # one row of bytes holds 2^31 - 1 at most


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A folder with one large file that takes no disk, and small ones beside it."""
    folder = tmp_path_factory.mktemp("large files+(1)")
    for name in ("region", "nation", "supplier"):
        (folder / f"{name}.parquet").write_bytes(name.encode() * 100)
    with open(folder / "lineitem.parquet", "wb") as f:
        f.truncate(LARGE)
        f.seek(LARGE - 3)
        f.write(b"\n\r\x00")
    (folder / "notes.txt").write_text("not a table")
    return str(folder)


def _sha256(path):
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def test_a_file_beyond_two_gigabytes_is_in_the_manifest(spark, large):
    got = {r.path: (r.length, r.sha256) for r in artifact_queries.artifact_manifest(spark, large).collect()}
    assert got == {n: (os.path.getsize(f"{large}/{n}"), _sha256(f"{large}/{n}")) for n in os.listdir(large) if n.endswith(".parquet")}
    assert got["lineitem.parquet"][0] == LARGE


def test_the_integrity_check_reads_it_too(spark, large):
    got = {r.path: (r.status, r.message) for r in artifact_queries.integrity_check(spark, large).collect()}
    assert {p: s for p, (s, _) in got.items()} == {
        "lineitem.parquet": "OK", "region.parquet": "EXTRA", "nation.parquet": "SIZE", "supplier.parquet": "CHECKSUM", "ghost.parquet": "MISSING"}
    assert f"got size=800 checksum={_sha256(f'{large}/supplier.parquet')}" in got["supplier.parquet"][1]


def test_paths_are_relative_and_only_matching_files_are_hashed(spark, large):
    got = {r.path: r.sha256 for r in artifact.manifest(hashed_objects(spark, large, "[ns]*.parquet"), large).collect()}
    assert got == {n: _sha256(f"{large}/{n}") for n in ("nation.parquet", "supplier.parquet")}


@pytest.fixture
def small_rows(spark):
    """Rows hold 1,000 bytes here, and splits 64 KB."""
    settings = {files.LIMIT: "1000", "spark.sql.files.maxPartitionBytes": "65536"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_where_only_spark_reads_a_large_file_is_read_as_lines(spark, tmp_dir, small_rows):
    rng = random.Random(5)
    os.makedirs(f"{tmp_dir}/a (b)+c/index_id=1")
    data = {"random.bin": rng.randbytes(700_000), "ends.bin": rng.randbytes(5000) + b"\n", "feeds.bin": b"\n" * 30_001,
            "returns.bin": b"a\r\n\r" * 3000, "zeros.bin": bytes(300_000), "at the limit%41.bin": b"x" * 1000, "small.bin": b"\n",
            "a (b)+c/od d%20+é.bin": rng.randbytes(2000), "a (b)+c/index_id=1/part.bin": b"\n" + rng.randbytes(1500), "other.txt": b"t" * 2000}
    for name, content in data.items():
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(content)
    got = [tuple(r) for r in files._hashed_by_spark(spark, tmp_dir, "*.bin").collect()]
    assert sorted(got) == sorted((f"file:{tmp_dir}/{n}", os.path.basename(n), len(c), hashlib.sha256(c).hexdigest())
                                 for n, c in data.items() if n.endswith(".bin"))
    assert sorted(got) == sorted(tuple(r) for r in hashed_objects(spark, tmp_dir, "*.bin").collect())


@pytest.mark.parametrize("name, content", [("x.bin", b"\xef\xbb\xbf" + b"x" * 2000), ("x.gz", gzip.compress(random.Random(6).randbytes(3000)))])
def test_lines_that_are_not_the_file_fail_the_job(spark, tmp_dir, small_rows, name, content):
    with open(f"{tmp_dir}/{name}", "wb") as f:
        f.write(content)
    with pytest.raises(Exception, match="bytes, its lines"):
        files._hashed_by_spark(spark, tmp_dir).collect()
    assert hashed_objects(spark, tmp_dir).first().sha256 == hashlib.sha256(content).hexdigest()

"""The commit log of a published version.

A version's folder holds attempts (``data-*``, each written once by one writer), a
manifest for each of them, and ``commits/<number>.json``. A commit names the attempt that counts. It is
created only if no file of its number exists, so of writers that started from the same commit one wins and the others
get a ``PublishConflict``; readers pin the attempt of the latest commit and
keep it, whatever is published meanwhile. Nothing is removed by name: an attempt goes when
the commit that replaced it is older than the retention.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from lexidx.session import child_names, delete_path, path_exists

FOLDER = "commits"
MANIFEST = "_manifest"
ATTEMPT = "data-"
RETENTION_SECONDS = 24 * 3600


class PublishConflict(RuntimeError):
    """Another writer has committed the same version since this one started."""


@dataclass(frozen=True)
class Commit:
    number: int
    attempt: str
    doc_count: int
    files: int
    bytes: int
    checksum: str
    committed_at: float

    def data(self, path: str) -> str:
        return f"{path}/{self.attempt}"

    def manifest(self, path: str) -> str:
        return manifest_path(path, self.attempt)


def manifest_path(path: str, attempt: str) -> str:
    return f"{path}/{MANIFEST}/attempt={attempt}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a file or folder on a local (or mounted) disk; None on any other file system."""
    p, fs = _file_system(spark, path)
    return p.toUri().getPath() if fs.getScheme() == "file" else None


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless one of that name exists; False if it does. Of concurrent callers one gets True.

    The text goes to a file of its own first. On a local disk that file is linked to the name (which fails if
    it is taken), elsewhere the name is created with Hadoop's exclusive create, which
    distributed file systems and conditional-put object stores do atomically.
    """
    p, fs = _file_system(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        name = p.toUri().getPath()
        draft = f"{name}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001 - the JVM's error tells which it is
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def log(spark: SparkSession, path: str) -> list[Commit]:
    """All commits of a version, the first one first: one small file for each publication."""
    folder = f"{path}/{FOLDER}"
    if not path_exists(spark, folder):
        return []
    names = [n for n in child_names(spark, folder) if n.endswith(".json")]
    return [Commit(**json.loads(read_text(spark, f"{folder}/{n}"))) for n in sorted(names)]


def latest(spark: SparkSession, path: str) -> Commit | None:
    folder = f"{path}/{FOLDER}"
    names = [n for n in child_names(spark, folder) if n.endswith(".json")] if path_exists(spark, folder) else []
    return Commit(**json.loads(read_text(spark, f"{folder}/{max(names)}"))) if names else None


def commit(spark: SparkSession, path: str, after: Commit | None, attempt: str, doc_count: int, files: int, size: int, checksum: str) -> Commit:
    """Make ``attempt`` the one that counts, if ``after`` is still the latest commit."""
    new = Commit((after.number if after else 0) + 1, attempt, doc_count, files, size, checksum, time.time())
    if not create_if_absent(spark, f"{path}/{FOLDER}/{new.number:012d}.json", json.dumps(asdict(new))):
        raise PublishConflict(f"Commit {new.number} of {path} was made by another writer")
    return new


def discard_attempt(spark: SparkSession, path: str, attempt: str) -> None:
    delete_path(spark, f"{path}/{attempt}")
    delete_path(spark, manifest_path(path, attempt))


def expire(spark: SparkSession, path: str, retention: float = RETENTION_SECONDS, now: float | None = None) -> list[str]:
    """Remove attempts that a later commit replaced more than ``retention`` seconds ago; what was never committed
    belongs to its writer or to the sweep of orphans. Returns the attempts that went."""
    now = time.time() if now is None else now
    commits = log(spark, path)
    old = [c.attempt for c, after in zip(commits, commits[1:]) if now - after.committed_at >= retention]
    gone = [a for a in old if path_exists(spark, f"{path}/{a}")]
    for attempt in gone:
        discard_attempt(spark, path, attempt)
    return gone

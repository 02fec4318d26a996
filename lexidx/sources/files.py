"""Stored objects read through the Hadoop filesystem."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import commits

PIECE_BYTES = 1 << 20


def list_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root`` as (path, name, length, content).

    Where ``content`` is used each file is read whole by one task (binaryFile), so published tables cap
    their file size with ``maxRecordsPerFile``; a file beyond the reader's 2 GB
    fails the job loudly (``hashed_objects`` takes it). Names that start with ``_`` or ``.`` are skipped here as
    in every other file source, so they can never become part of a table.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


LIMIT = "spark.sql.sources.binaryFile.maxLength"


def _digest(batches):
    """(path, length, sha256) of the file whose lines these are; each line comes with its line feed.

    Whether the last line has one shows in the size of the file, so the last byte is held back.
    """
    path, size, seen, held, digest = None, 0, 0, b"", hashlib.sha256()
    for batch in batches:
        if not batch.num_rows:
            continue
        if path is None:
            path, size = batch.column("path")[0].as_py(), batch.column("size")[0].as_py()
        if {batch.column("path")[0].as_py(), batch.column("path")[-1].as_py()} != {path}:
            raise ValueError(f"A task has lines of more files than {path}")
        lines = batch.column("line")
        _, offsets, data = lines.buffers()
        ends = np.frombuffer(offsets, np.int32)[lines.offset:lines.offset + len(lines) + 1]
        piece = memoryview(data)[ends[0]:ends[-1]]
        digest.update(held)
        digest.update(piece[:-1])
        seen, held = seen + len(piece), bytes(piece[-1:])
    if path is not None:
        if seen == size:
            digest.update(held)
        elif seen != size + 1:
            raise ValueError(f"{path} has {size} bytes, its lines {seen}")
        plain = re.sub(r"^([^:/]+):///", r"\1:/", unquote(path))
        yield pa.RecordBatch.from_pylist([{"path": plain, "length": size, "sha256": digest.hexdigest()}])


def _hashed_by_spark(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``hashed_objects`` for a storage that only Spark's readers open.

    A file is one row of bytes as far as a row can hold it. A larger one is read as text lines, which are its bytes too:
    by one task, in order, a batch of lines at a time. A compressed file, or one that starts with a byte order
    mark, doesn't come back byte for byte; its length shows that, and the job fails.
    """
    files, limit = list_objects(spark, root, glob), int(spark.conf.get(LIMIT))
    hashed = files.select("path", "name", "length", F.sha2("content", 256).alias("sha256"))
    if files.where(F.col("length") > limit).isEmpty():
        return hashed
    # The scan's own session: a file is never cut, and never shares a task with another.
    apart = spark.newSession()
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(k, str(1 << 50))
    r = apart.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = r.load(root).where(F.col("_metadata.file_size") > limit).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("line"))
    large = lines.mapInArrow(_digest, "path string, length long, sha256 string")
    return hashed.where(F.col("length") <= limit).unionByName(
        large.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256"))


def hashed_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The files of ``list_objects`` as (path, name, length, sha256), hashed by the tasks that list them.

    On a local disk a file is read in pieces, so one of any size takes a task no more memory than a small one.
    """
    if commits.local_path(spark, root) is None:
        return _hashed_by_spark(spark, root, glob)
    files = list_objects(spark, root, glob)

    def sha256(path):
        digest = hashlib.sha256()
        with open(path.removeprefix("file:"), "rb") as f:
            while piece := f.read(PIECE_BYTES):
                digest.update(piece)
        return digest.hexdigest()

    return files.select("path", "name", "length", F.udf(sha256, "string")("path").alias("sha256"))

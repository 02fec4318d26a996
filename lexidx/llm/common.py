"""Helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.session import delete_path, scratch_path, table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def staged(spark: SparkSession, df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` and lets later passes read only the
    columns they need; a lost executor costs no recomputation of what came before.
    The path is added to ``written`` for callers that can tell when it is no longer read.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Remove staged tables that nothing reads any more."""
    for path in written:
        delete_path(spark, path)
    written.clear()


class Shipped:
    """A broadcast of an object whose class is this package's.

    Broadcasts name classes by their module, which workers need not have; here the class travels
    with the object (the package registers itself to be shipped by value). Built once in every task.
    """

    def __init__(self, spark: SparkSession, obj):
        self._bytes, self._built = spark.sparkContext.broadcast(cloudpickle.dumps(obj)), []

    def __getstate__(self):
        return {"_bytes": self._bytes, "_built": []}

    @property
    def value(self):
        if not self._built:
            self._built.append(pickle.loads(self._bytes.value))
        return self._built[0]


SLICE_ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function that turns each small batch into at most one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from every fit: crc32 of the id's text leaves 1 modulo 3.

    A null id has no label and is never learned from; it counts as not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one 0/1 label per id outside the held-out part.

    Rows without id or label are ignored; repeated ids take their majority, a tie counts as 1.
    """
    return (labels.select("doc_id", F.col(column).cast("double").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y")))


def bounded_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, the same ones on every run (smallest id hashes first)."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

"""One published version per table and session, shared by all lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import artifact, index
from lexidx.plans import tables
from lexidx.session import path_exists, scratch_path

INPUTS = {
    "documents": (tables.documents_index_input, tables.DOCUMENT_FIELDS),
    "part": (tables.part_index_input, tables.PART_FIELDS),
}
_roots: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def publish(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame]:
    """(root, description) of a fresh publication of ``name`` as version 1."""
    root = scratch_path(spark, f"published-{name}")
    read, fields = INPUTS[name]
    row = artifact.publish_version(spark, read(spark, sf_dir), fields, root, name, 1)
    return root, spark.createDataFrame(row.collect(), row.schema)


def shared(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame]:
    """The publication that this session's lookups read; made when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _roots or not path_exists(spark, artifact.version_path(_roots[key][0], name, 1)):
        _roots[key] = publish(spark, sf_dir, name)
    return _roots[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> index.IndexTables:
    root, _ = shared(spark, sf_dir, name)
    return index.read(spark, artifact.data_path(spark, root, name, 1))


def catalog_rows(description: DataFrame, status: str = "READY") -> DataFrame:
    """The version row a catalog would hold for what was published."""
    return description.select("index_id", "version", F.lit(status).alias("status"), "doc_count")

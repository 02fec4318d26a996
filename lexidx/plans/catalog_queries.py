"""Registered queries for definitions, catalog and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import catalog, schema
from lexidx.plans import fixtures, tables

PAGE, PAGE_SIZE = 2, 20
NAMELESS_MOD = 31


def definition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.definition_audit(fixtures.index_definitions(spark, sf_dir))


def fields_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.index_definitions(spark, sf_dir)
    back = schema.map_to_fields(schema.fields_to_map(F.col("fields")))
    return d.select("index_id", F.posexplode(back).alias("position", "f")).select(
        "index_id", "position", F.col("f.name").alias("name"), F.col("f.type").alias("type"))


def register_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    batch = c.select(k.alias("req_id"), F.when(k % NAMELESS_MOD == 0, F.lit(None)).when(k % 3 == 0, F.lower("c_name")).otherwise(
        F.concat(F.lit("fresh_"), (k % 97).cast("string"))).alias("name"))
    return catalog.register_indexes(batch, fixtures.search_index(spark, sf_dir))


def lookup_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup_indexes(fixtures.index_requests(spark, sf_dir), fixtures.search_index(spark, sf_dir))


def list_indexes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_indexes_page(fixtures.search_index(spark, sf_dir), PAGE, PAGE_SIZE)


def list_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer")
    req = c.select(F.when(F.col("c_custkey") % 500 == 3, F.col("c_custkey") + 1000000)
                   .otherwise(F.col("c_custkey")).alias("index_id"))
    return catalog.list_versions(req, fixtures.search_index(spark, sf_dir), fixtures.index_version(spark, sf_dir))


def _resolved(spark, sf_dir):
    return catalog.resolve_versions(fixtures.version_requests(spark, sf_dir),
                                    fixtures.search_index(spark, sf_dir), fixtures.index_version(spark, sf_dir))


def resolve_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("req_id", "index_id", "version", "version_id",
                                           "resolution", "status", "message")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.next_version(fixtures.search_index(spark, sf_dir), fixtures.index_version(spark, sf_dir))


def active_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_builds(fixtures.index_version(spark, sf_dir))


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.constraint_audit(fixtures.search_index(spark, sf_dir), fixtures.index_version(spark, sf_dir))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = fixtures.search_index(spark, sf_dir)
    deleted = cat.where(F.col("index_id") % 10 == 0).select("index_id")
    _, ver = catalog.cascade_delete(cat, fixtures.index_version(spark, sf_dir), deleted)
    return ver.select("version_id", "index_id", "version", "status")


def artifact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.artifact_gate(_resolved(spark, sf_dir))


def version_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalog.fold_versions(fixtures.lifecycle_events(spark, sf_dir))
    return f.select("version_id", "status", "doc_count", "artifact_size", "checksum",
                    "artifact_key", "error_message", "applied_events")


def audit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalog.fold_versions(fixtures.lifecycle_events(spark, sf_dir))
    return f.select("version_id", F.col("created_at").cast("string").alias("created_at"),
                    F.col("updated_at").cast("string").alias("updated_at"))


QUERIES = {
    "definition_audit": definition_audit,
    "fields_roundtrip": fields_roundtrip,
    "register_indexes": register_indexes,
    "lookup_indexes": lookup_indexes,
    "list_indexes_page": list_indexes_page,
    "list_versions": list_versions,
    "resolve_versions": resolve_versions,
    "next_version": next_version,
    "active_builds": active_builds,
    "constraint_audit": constraint_audit,
    "cascade_delete": cascade_delete,
    "artifact_gate": artifact_gate,
    "version_state_fold": version_state_fold,
    "audit_times": audit_times,
}

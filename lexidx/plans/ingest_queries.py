"""Registered queries for scanning and validating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import schema, validate
from lexidx.operators.schema import FieldType
from lexidx.plans import fixtures, tables
from lexidx.sources import ndjson


def _lines(spark, sf_dir):
    return ndjson.read_lines(spark, fixtures.write_g1(spark, sf_dir))


def _validated(spark, sf_dir):
    return validate.validate(ndjson.parse(_lines(spark, sf_dir)), tables.PART_FIELDS)


def ndjson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.json_fields(ndjson.parse(_lines(spark, sf_dir)))


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.malformed_lines(ndjson.parse(_lines(spark, sf_dir)))


def _errors_of(kind):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = validate.errors(_validated(spark, sf_dir), tables.PART_FIELDS)
        return e.where(F.col("kind") == kind).select("line", "field", "message")
    return q


def _coerce_of(ftype: FieldType):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _validated(spark, sf_dir)
        parts = [validate.coerced(v, f) for f in tables.PART_FIELDS if f.type is ftype]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return q


def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.first_error(_validated(spark, sf_dir), tables.PART_FIELDS)


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.typed_documents(_validated(spark, sf_dir), tables.PART_FIELDS)


def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.doc_count(_validated(spark, sf_dir))


QUERIES = {
    "ndjson_scan": ndjson_scan,
    "json_fields": json_fields,
    "malformed_lines": malformed_lines,
    "unknown_fields": _errors_of("UNKNOWN_FIELD"),
    "null_fields": _errors_of("NULL"),
    "coerce_keyword": _coerce_of(FieldType.KEYWORD),
    "coerce_text": _coerce_of(FieldType.TEXT),
    "coerce_long": _coerce_of(FieldType.LONG),
    "coerce_double": _coerce_of(FieldType.DOUBLE),
    "coerce_boolean": _coerce_of(FieldType.BOOLEAN),
    "type_mismatch_report": _errors_of("TYPE_MISMATCH"),
    "first_error": first_error,
    "typed_documents": typed_documents,
    "doc_count": doc_count,
}

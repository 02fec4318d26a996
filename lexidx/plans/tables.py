"""Readers for the driver's tables and the index definitions over them.

Each index here is an ordinary typed document table plus a field list; it
is what a user would get from ``validate`` on an NDJSON document set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators.schema import fields_of
from lexidx.session import ensure_conf, table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    return spark.read.parquet(table_path(sf_dir, name))


# Index over `documents`: the text plus three stored attributes.
DOCUMENT_FIELDS = fields_of([("text", "text"), ("lang", "keyword"),
                             ("source", "keyword"), ("n_chars", "long")])


def documents_index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars")


# Index over `part`: the G1 document shape (title, tag, count, price, in_stock).
PART_FIELDS = fields_of([("title", "text"), ("tag", "keyword"), ("count", "long"),
                         ("price", "double"), ("in_stock", "boolean")])


def part_index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("tag"), F.col("p_size").cast("bigint").alias("count"),
        F.col("p_retailprice").alias("price"), (F.col("p_size") % 2 == 0).alias("in_stock"))


# Index over `labels`: two boolean flags per document.
LABEL_FIELDS = fields_of([("quality", "boolean"), ("toxic", "boolean")])


def labels_index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))

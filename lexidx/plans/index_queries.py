"""Registered queries for index build and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.functions import analyzer
from lexidx.operators import artifact, index, requests, search
from lexidx.plans import published, tables
from lexidx.session import child_names, scratch_path

# Fixed query parameters of the registered lookups.
BM25_TERMS = ["that", "was", "der", "la"]
BM25_K = 10
TEXT_TERM = "was"
KEYWORD_TERM = "Brand#1"
LONG_RANGE = (10, 20)
DOUBLE_RANGE = (1000.0, 1100.0)
REQUEST_TAGS = 40
RANGE_WIDTH = 3


def _docs(spark, sf_dir):
    d = index.spread(tables.documents_index_input(spark, sf_dir))
    return d, index.build(d, tables.DOCUMENT_FIELDS)


def analyze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = index.spread(tables.documents_index_input(spark, sf_dir))
    return analyzer.analyze(d, "text", "doc_id")


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = index.spread(tables.documents_index_input(spark, sf_dir))
    p = index.text_postings(d, "text")
    return p.select("field", "term", "doc_id", "tf",
                    F.array_join("positions", ",").alias("positions"), "dl")


def keyword_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.part_index_input(spark, sf_dir)
    return index.keyword_postings(d, "tag").select("field", "term", "doc_id", "tf")


def boolean_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.labels_index_input(spark, sf_dir)
    return index.postings(d, tables.LABEL_FIELDS).select("field", "term", "doc_id", "tf")


def long_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.part_index_input(spark, sf_dir)
    return index.points(d, tables.PART_FIELDS, index.FieldType.LONG)


def double_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.part_index_input(spark, sf_dir)
    return index.points(d, tables.PART_FIELDS, index.FieldType.DOUBLE)


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = _docs(spark, sf_dir)
    return t.stored


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = _docs(spark, sf_dir)
    return t.terms()


def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = _docs(spark, sf_dir)
    return t.stats().select("field", "doc_count", "sum_length",
                            F.round("avg_length", 6).alias("avg_length"))


def verify_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents given against documents read back from the published version."""
    return index.verify_build(tables.documents_index_input(spark, sf_dir), published.read(spark, sf_dir, "documents").stored)


def write_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish a fresh version, read every table back, count its rows."""
    root, _ = published.shared(spark, sf_dir, "documents")
    path = artifact.data_path(spark, root, "documents", 1)
    parts = [spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count") for name in child_names(spark, path)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bm25_hits(spark, sf_dir):
    t = published.read(spark, sf_dir, "documents")
    return t, search.bm25_topk_version(t, "text", BM25_TERMS, BM25_K)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _bm25_hits(spark, sf_dir)
    return hits.select("rank", "doc_id", F.round("score", 6).alias("score"))


def fetch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, hits = _bm25_hits(spark, sf_dir)
    return search.fetch_version(t, hits, max_hits=BM25_K).select(
        "rank", "doc_id", F.round("score", 6).alias("score"), "lang", "source", "n_chars", "text")


def term_lookup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_lookup(published.read(spark, sf_dir, "documents").postings, "text", TEXT_TERM)


def term_lookup_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_lookup(published.read(spark, sf_dir, "part").postings, "tag", KEYWORD_TERM)


def numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = published.read(spark, sf_dir, "part")
    lo = search.numeric_range(t.long_points, "count", *LONG_RANGE).select(
        F.lit("count").alias("field"), "doc_id", F.col("value").cast("double").alias("value"))
    hi = search.numeric_range(t.double_points, "price", *DOUBLE_RANGE).select(
        F.lit("price").alias("field"), "doc_id", "value")
    return lo.unionByName(hi)


def sort_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.part_index_input(spark, sf_dir)
    t = index.build(d, tables.PART_FIELDS)
    return search.sort_by_field(t.stored, "price", descending=True).select("doc_id", "price", "tag")


def _buckets(spark, name, write):
    """A bucketed copy of the published part index for one query."""
    return write(scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions")))


def term_lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1/Q2 for a table of requests: one for each order, some for tags that no part has."""
    t = published.read(spark, sf_dir, "part")
    b = _buckets(spark, "postings-buckets", lambda path, n: requests.bucket_postings(t.postings, t.terms(), path, n))
    tag = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % REQUEST_TAGS).cast("string"))
    asked = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.lit("tag").alias("field"), tag.alias("term"))
    found = requests.term_lookups(b, requests.once_each(asked, requests.TERM)).groupBy("req_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("doc_sum"))
    return requests.answered(asked, found, requests.TERM).groupBy("req_id").agg(
        F.sum("hits").alias("hits"), F.min("first_doc").alias("first_doc"), F.sum("doc_sum").alias("doc_sum"))


def numeric_range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 for a table of requests: a price range for each customer."""
    t = published.read(spark, sf_dir, "part")
    b = _buckets(spark, "points-buckets", lambda path, n: requests.bucket_points(t.double_points, path, n))
    lo = F.col("c_custkey") % 1000 + 900
    asked = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.lit("price").alias("field"), lo.cast("double").alias("lo"),
                                                           F.when(F.col("c_custkey") % 50 != 0, (lo + RANGE_WIDTH).cast("double")).alias("hi"))
    found = requests.range_lookups(b, requests.once_each(asked, requests.RANGE)).groupBy("req_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("value").alias("least"), F.max("value").alias("most"))
    return requests.answered(asked, found, requests.RANGE).groupBy("req_id").agg(
        F.sum("hits").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))


QUERIES = {
    "analyze_text": analyze_text,
    "text_postings": text_postings,
    "keyword_postings": keyword_postings,
    "boolean_postings": boolean_postings,
    "long_points": long_points,
    "double_points": double_points,
    "stored_documents": stored_documents,
    "term_dictionary": term_dictionary,
    "field_stats": field_stats,
    "verify_build": verify_build,
    "write_index": write_index,
    "term_lookup_keyword": term_lookup_keyword,
    "term_lookup_text": term_lookup_text,
    "bm25_topk": bm25_topk,
    "fetch_stored": fetch_stored,
    "numeric_range": numeric_range,
    "term_lookup_requests": term_lookup_requests,
    "numeric_range_requests": numeric_range_requests,
    "sort_by_field": sort_by_field,
}

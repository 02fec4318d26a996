"""Tables of requests against buckets: rows of single lookups, no exchange of postings or points."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lexidx.operators import index, requests, search
from lexidx.operators.schema import fields_of
from lexidx.plans import index_queries

FIELDS = fields_of([("body", "text"), ("tag", "keyword"), ("n", "long")])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows = [(d, " ".join(["hot", *rng.choices([f"w{i}" for i in range(50)], k=6)]), rng.choice(["red", "blue", None]), rng.choice([None, rng.randint(-50, 50)]))
            for d in range(1500)]
    return index.build(spark.createDataFrame(rows, "doc_id long, body string, tag string, n long"), FIELDS)


def test_term_requests_equal_single_lookups(spark, tables, tmp_dir):
    b = requests.bucket_postings(tables.postings, tables.terms(), f"{tmp_dir}/p", 6, slice_postings=400)
    assert {x[1] for x in b.cuts["slices"]} >= {"hot"}
    asked = [(1, "body", "hot"), (2, "body", "w3"), (3, "tag", "red"), (4, "body", "nowhere"), (5, "body", "w3"), (6, None, "w3")]
    df = spark.createDataFrame(asked, "req_id long, field string, term string")
    want = {(r, x.doc_id, x.tf) for r, f, t in asked if f for x in search.term_lookup(tables.postings, f, t).collect()}
    for buckets in (b, requests.open_buckets(spark, f"{tmp_dir}/p")):
        got = requests.term_lookups(buckets, df).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        requests.close_buckets(spark, buckets)


def test_range_requests_equal_single_lookups(spark, tables, tmp_dir):
    b = requests.bucket_points(tables.long_points, f"{tmp_dir}/n", 4, cells=16)
    asked = [(1, "n", -10, 10), (2, "n", None, -40), (3, "n", 45, None), (4, "n", 5, 5), (5, "n", 9, 3), (6, "none", 0, 9), (7, "n", None, None)]
    df = spark.createDataFrame(asked, "req_id long, field string, lo long, hi long")
    want = {(r, x.doc_id, x.value) for r, f, lo, hi in asked for x in search.numeric_range(tables.long_points, f, lo, hi).collect()}
    got = requests.range_lookups(b, df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    requests.close_buckets(spark, b)


def test_only_requests_are_exchanged(spark, tables, tmp_dir):
    b = requests.bucket_postings(tables.postings, tables.terms(), f"{tmp_dir}/p", 8, slice_postings=400)
    df = spark.createDataFrame([(1, "body", "w1")], "req_id long, field string, term string")
    plan = requests.term_lookups(b, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    scan = plan[:plan.index("FileScan")]
    assert scan.count("Exchange") == 0  # the postings come first, straight from their files
    requests.close_buckets(spark, b)


def test_totals_of_requests_that_ask_the_same_are_found_once(spark, tables, tmp_dir):
    b = requests.bucket_points(tables.long_points, f"{tmp_dir}/n", 4, cells=16)
    asked = [(1, "n", -10, 10), (2, "n", None, -40), (3, "n", None, -40), (3, "n", None, -40), (None, "n", -10, 10), (4, "n", None, None), (5, None, 1, 2), (6, "n", 90, 99)]
    df = spark.createDataFrame(asked, "req_id long, field string, lo long, hi long")

    def totals(rows):
        return rows.groupBy("req_id").agg(F.count(F.lit(1)).alias("hits"), F.min("value").alias("least"))

    once = requests.once_each(df, requests.RANGE)
    assert once.count() == 5
    found = requests.answered(df, totals(requests.range_lookups(b, once)), requests.RANGE).groupBy("req_id").agg(
        F.sum("hits").alias("hits"), F.min("least").alias("least"))
    want = totals(requests.range_lookups(b, df))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 5
    requests.close_buckets(spark, b)


@pytest.fixture(scope="module")
def many_requests(spark):
    """Four times as many orders and customers as there are terms and ranges to ask for."""
    folder = tempfile.mkdtemp(prefix="lexidx-test-")
    parts = [(i, f"part {i}", f"Brand#{i % 25}", i % 50, 900.0 + i % 1000) for i in range(300)]
    for name, rows, schema in (
            ("part", parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
            ("orders", [(i % 900,) for i in range(1000)] + [(None,)], "o_orderkey long"),
            ("customer", [(i,) for i in range(4000)] + [(None,)], "c_custkey long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize(("query", "look_up", "most"), [("term_lookup_requests", "term_lookups", 41), ("numeric_range_requests", "range_lookups", 1001)])
def test_registered_requests_look_up_each_thing_once(spark, monkeypatch, many_requests, query, look_up, most):
    asked, original = [], getattr(requests, look_up)
    monkeypatch.setattr(requests, look_up, lambda b, df: asked.append(df) or original(b, df))
    assert index_queries.QUERIES[query](spark, many_requests).count() > 0
    assert 0 < asked[0].count() == asked[0].drop("req_id").distinct().count() <= most

"""The running count equals a sequential replay, whatever the key sizes."""

import random

from pyspark.sql import functions as F

from lexidx.operators import ordered


def _replay(rows):
    want, run = {}, {}
    for k, s, f, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        run[k] = run.get(k, 0) + int(bool(f))
        want[(k, s)] = run[k]
    return want


def test_hot_key_null_key_and_big_longs(spark):
    rnd = random.Random(3)
    rows = []
    for key, n in [(1, 9000), (2, 3), (None, 700), (4, 1), (5, 296)]:  # one key holds 90 % of the rows
        for i, s in enumerate(rnd.sample(range(10 ** 6), n)):
            rows.append((key, s, rnd.choice([True, False, None]), None if i % 7 == 0 else 2 ** 60 + 1 + s))
    df = spark.createDataFrame(rows, "k bigint, s bigint, f boolean, v bigint")
    want = _replay(rows)
    for ranges in (1, 8, 37, 300):
        got = ordered.running_count(df, "k", "s", "f", "c", ranges=ranges).collect()
        assert {(r.k, r.s): r.c for r in got} == want and len(got) == len(rows)
        assert {(r.k, r.s): r.v for r in got} == {(k, s): v for k, s, _, v in rows}


def test_sparse_order_splits_a_hot_key_by_rank(spark):
    """Epoch micros as order: far apart, yet the key's rows are cut into as many even parts as there are ranges."""
    df = spark.range(20_000).select(F.lit(7).alias("k"), (F.col("id") * 86_400_000_000).alias("s"), F.lit(True).alias("f"))
    for aqe in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        out = ordered.running_count(df, "k", "s", "f", "c", ranges=16)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert aqe == "true" or plan.count("ReusedExchange") == 1  # one exchange for both readers (AQE finds it when it runs)
        sizes = [r.n for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 14 and max(sizes) < 4 * 20_000 / 16
        assert out.agg(F.max("c"), F.countDistinct("c"), F.max(F.abs(F.col("c") - F.col("s") / 86_400_000_000 - 1))).first() == (20_000, 20_000, 0.0)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_text_keys_nulls_and_empty_tables(spark):
    rows = [("b", 1, True), ("a", None, True), ("a", None, None), ("a", 2, True), (None, None, True), (None, 5, True), ("", 1, False)]
    df = spark.createDataFrame(rows, "k string, s bigint, f boolean")
    got = sorted((r.k is not None, r.k or "", r.s or 0, r.c) for r in ordered.running_count(df, "k", "s", "f", "c", ranges=4).collect())
    assert [x[3] for x in got if x[:2] == (True, "b")] == [1] and [x[3] for x in got if not x[0]] == [1, 2] and [x[3] for x in got if x[:2] == (True, "")] == [0]
    assert [x[3] for x in got if x[:2] == (True, "a")][-1] == 2
    assert ordered.running_count(df.where("false"), "k", "s", "f", "c").count() == 0


def test_building_runs_no_job(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("s"), F.lit(True).alias("f"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("running-count", "plan only")
    try:
        out = ordered.running_count(df, "k", "s", "f", "c")
        assert not tracker.getJobIdsForGroup("running-count")
    finally:
        spark.sparkContext.setJobGroup("default", "")
    assert out.count() == 100

"""The fold by composition equals a sequential replay, however the log is cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexidx.operators import catalog, fold

SCHEMA = ("version_id bigint, seq bigint, ts timestamp, kind string, doc_count bigint, artifact_size bigint, "
          "checksum string, artifact_key string, error_message string")
KINDS = ["CREATED", "BUILDING", "BUILT", "UPLOADED", "READY", "FAILED", "NOISE", None]


def log_rows(rng, sizes, spread=10 ** 15):
    rows = []
    for version, n in sizes.items():
        for seq in rng.sample(range(1, spread), n):
            kind = "CREATED" if rng.random() < .1 else rng.choice(KINDS)
            rows.append((version, seq, datetime(2026, 1, 1) + timedelta(seconds=seq % 100_000), kind, rng.choice([None, seq % 97]), 2 ** 60 + seq,
                         f"c{seq}", f"k{seq}", rng.choice([None, f"e{seq}"])))
    rng.shuffle(rows)
    return rows


def replay(rows, states=None):
    """One event after the other, by the rules."""
    state = dict(states or {})
    for version, seq, ts, kind, n, size, ck, key, err in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        s = state.get(version)
        if s is None:
            if kind == "CREATED":
                state[version] = ["CREATED", None, None, None, None, None, 1, ts, ts]
            continue
        if kind == "READY" and s[0] == "UPLOADED" or kind == "BUILDING":
            new = [kind, *s[1:6]]
        elif kind == "BUILT":
            new = [kind, n, size, ck, *s[4:6]]
        elif kind == "UPLOADED":
            new = [kind, *s[1:4], key, s[5]]
        elif kind == "FAILED" and s[0] != "READY":
            new = [kind, None, None, None, None, err]
        else:
            continue
        state[version] = [*new, s[6] + 1, s[7], ts]
    return state


def rows_of(df):
    return {r.version_id: [r[c] for c in fold.ROW] for r in df.collect()}


SIZES = {1: 4000, 2: 1, 3: 60, 4: 300, **{v: 5 for v in range(5, 60)}}


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_any_cut_of_the_log_gives_the_replayed_rows(spark, parts):
    rows = log_rows(random.Random(1), SIZES) + [(None, 1, None, "CREATED", None, None, None, None, None)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_of(fold.fold(spark.createDataFrame(rows, SCHEMA))) == replay(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_snapshot_and_delta_equal_a_full_replay(spark):
    rows = log_rows(random.Random(2), SIZES, spread=100_000)
    old, new = [r for r in rows if r[1] < 60_000], [r for r in rows if r[1] >= 60_000]
    snapshot = fold.fold(spark.createDataFrame(old, SCHEMA))
    both = fold.fold(spark.createDataFrame(new, SCHEMA), snapshot)
    assert rows_of(both) == replay(rows) == replay(new, replay(old))
    assert rows_of(fold.fold(spark.createDataFrame([], SCHEMA), snapshot)) == replay(old)


def test_hot_version_with_sparse_seq_is_split_over_tasks(spark):
    """A version with 90 % of the rows and seq values far apart: the stretches come from many tasks, of even size."""
    rows = log_rows(random.Random(3), {1: 9000, **{v: 10 for v in range(2, 102)}})
    log = spark.createDataFrame(rows, SCHEMA).withColumn("snapshot", F.lit(None).cast("struct<status:string>"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = fold.stretches(log).where("version_id = 1").count()
        assert parts >= 6  # of 8 shuffle partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_scan_and_no_window(spark, tmp_dir):
    spark.createDataFrame(log_rows(random.Random(4), {1: 10}), SCHEMA).write.parquet(f"{tmp_dir}/log")
    plan = fold.fold(spark.read.parquet(f"{tmp_dir}/log"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Window" not in plan and "Join" not in plan
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning") == 1


def test_functions_compose_in_any_grouping():
    """(a after b) after c is a after (b after c), for every status."""
    rng = random.Random(5)
    for _ in range(300):
        events = [(rng.choice(KINDS), i, i, i, f"c{i}", f"k{i}", f"e{i}") for i in range(rng.randint(0, 9))]
        for status in fold.BEFORE:
            whole = fold.start(status)
            for e in events:
                fold.step(whole, *e)
            cut = rng.randint(0, len(events))
            left = fold.start(status)
            for e in events[:cut]:
                fold.step(left, *e)
            right = fold.start(left[0])
            for e in events[cut:]:
                fold.step(right, *e)
            assert right[fold.STATUS] == whole[fold.STATUS]
            assert left[fold.APPLIED] + right[fold.APPLIED] == whole[fold.APPLIED]
            for places, flag in ((range(1, 4), fold.BUILD_SET), ((4,), fold.KEY_SET), ((5,), fold.ERROR_SET)):
                for p in places:
                    assert whole[p] == (right[p] if right[flag] else left[p])


def test_outcomes_and_fold_agree(spark):
    rows = log_rows(random.Random(6), SIZES, spread=1 << 22)
    log = spark.createDataFrame([r for r in rows if r[3] not in ("NOISE", None)], SCHEMA)
    applied = {r.version_id: r.n for r in catalog.classify_events(log).where("outcome = 'APPLIED'").groupBy("version_id").agg(F.count("*").alias("n")).collect()}
    assert {v: s[6] for v, s in rows_of(catalog.fold_versions(log)).items()} == applied

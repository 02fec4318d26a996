"""Recall against brute force, exact scores, ties, unusable vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexidx.llm import ann, queries
from tests.llm.helpers import SF_SMALL

KIND = "vec_id long, embedding array<float>"


def brute(vectors, asked, k=5):
    """{query: [(id, cosine)]} in double precision, ties to the smaller id."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in asked:
        score = ann.cosines(np.repeat(np.array([vectors[q]], np.float64), len(x), axis=0), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    got = {}
    for r in sorted(queries.op8_ann(spark, SF_SMALL).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(brute(vectors, [q], len(vectors))[q]) for q in got}
    for q, found in got.items():
        assert all(math.isclose(s, scores[q][i], abs_tol=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_hot_vector_ties_and_split_lists(spark):
    """A third of all vectors are equal: lists are cut into parts, ties go to smaller ids."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    got = ann.search(df, F.col("vec_id") % 50 == 0, list_rows=40, probe=5.0).collect()
    want = brute({i: np.float32(v) for i, v in rows}, range(0, 600, 50))
    for q in range(0, 600, 50):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == [i for i, _ in want[q]], q


def test_unusable_vectors_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (7, []), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, None)]
    df = spark.createDataFrame(rows, KIND).withColumn("list", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_small_isolated_groups_find_k_others(spark):
    """Groups of one to four equal vectors far from the rest have lists to themselves; the tuned ratio is used."""
    rng = np.random.default_rng(3)
    axis = np.eye(16)
    rows = [(i, (axis[0] + rng.normal(size=16) * 0.001).tolist()) for i in range(1, 1500) if i % 50]
    for n in range(1, 5):
        rows += [(10_000 * n + 50 * j, (axis[n] + 0.1 * axis[n + 5]).tolist()) for j in range(n)]
    got = ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 50 == 0).collect()
    asked = [i for i, _ in rows if i % 50 == 0]
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in asked}
    assert all(len(set(found[q])) == 5 and q not in found[q] for q in asked), found
    want = brute({i: np.float32(v) for i, v in rows}, asked)
    for q in asked:  # its own group comes first
        twins = [i for i, s in want[q] if s > 0.99]
        assert found[q][:len(twins)] == twins


def test_few_vectors_in_all_are_all_found():
    """Lists of one vector each: the walk goes on until k + 1 are held, or to the end."""
    lists = ann.Centroids(np.eye(12), 12)
    held = np.bincount([c[0] for c in lists.replicas(np.eye(12), 0.0)], minlength=len(lists.x))
    for v in np.eye(12):
        assert held[lists.probes(v, 0.02, held, 6)].sum() >= 6
        assert held[lists.probes(v, 0.02, held, 40)].sum() == 12

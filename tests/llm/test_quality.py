"""Held-out accuracy, calibration, and the awkward rows."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from lexidx.llm import quality, queries
from lexidx.llm.common import held_out
from tests.llm.helpers import clashing, docs

SF = "/root/testdata/sf0.01"


def test_isotonic_equals_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(30.0), rng.random(30), rng.integers(1, 5, 30).astype(float)
    centres, values = quality.isotonic(x, y, w)
    assert (np.diff(values) >= 0).all()
    # max-min formula of isotonic regression
    want = [max(min(np.average(y[i:j + 1], weights=w[i:j + 1]) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    assert np.allclose(np.unique(np.round(want, 9)), values)
    for c, v in zip(centres, values, strict=True):
        block = np.isclose(want, v)
        assert np.isclose(c, np.average(x[block], weights=w[block]))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    rows = [r for r in queries.op1_quality(spark, SF).collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    away = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(away) > 50 and np.mean([p == y for p, y in away]) > 0.95


def test_edge_rows_and_missing_labels(spark):
    rows = docs(spark, ["good words in a row", None, "", "x" * 50000, "good words in a row"], [(None, "no id")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(clashing(rows), none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.score(rows, one).collect()
    assert len(got) == 6 and all(r.score is not None for r in got)
    flags = {r.doc_id: r.h for r in rows.select("doc_id", held_out().alias("h")).collect()}
    assert flags[None] is False
    assert quality.keep_good(clashing(rows), none).columns == clashing(rows).columns
    assert quality.score(rows.limit(0), one).count() == 0


def test_scores_equal_a_direct_solve(spark):
    """The whole fit again from its definition, in one matrix: standardised statistics, ridge by least squares
    (all rows, and without each fold), pooled out-of-fold scores, then every document's score."""
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    ids = sorted(d for d in labels if d in table and zlib.crc32(str(d).encode()) % 3 != 1)
    folds = {r.d: r.f for r in spark.createDataFrame([(d,) for d in ids], "d long").select("d", F.pmod(F.xxhash64("d"), F.lit(quality.FOLDS)).alias("f")).collect()}
    stats = {d: quality.statistics(t.encode()).astype(np.float32).astype(float) for d, t in table.items()}
    x, y, fold = np.stack([stats[d] for d in ids]), np.array([labels[d] for d in ids], float), np.array([folds[d] for d in ids])
    plain = quality.Model(x.mean(axis=0), x.std(axis=0) + 1e-6)

    def solve(rows):
        z = plain.expand(x[rows])
        penalty = np.sqrt(np.append(np.full(z.shape[1] - 1, quality.RIDGE), 1e-9))
        return np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(y[rows], np.zeros(len(penalty))), rcond=None)[0]

    away = np.zeros(len(ids))
    for k in range(quality.FOLDS):
        away[fold == k] = np.clip(plain.expand(x[fold == k]) @ solve(fold != k), -1, 2)
    bins, of = np.unique(np.floor(away * quality.GRID), return_inverse=True)
    mean, n = np.bincount(of, y) / np.bincount(of), np.bincount(of).astype(float)
    m = len(bins)
    sums, weights = np.append(0, np.cumsum(mean * n)), np.append(0, np.cumsum(n))
    averages = [[(sums[j + 1] - sums[i]) / (weights[j + 1] - weights[i]) for j in range(i, m)] for i in range(m)]
    value = np.array([max(min(averages[i][k - i:]) for i in range(k + 1)) for k in range(m)])  # max-min formula
    value = np.round(value, 12)
    steps = np.unique(value)
    centre = np.array([np.average((bins[value == v] + 0.5) / quality.GRID, weights=n[value == v]) for v in steps])
    beta = solve(np.ones(len(ids), bool))
    raw = {d: float(np.clip(plain.expand(s[None, :]) @ beta, -1, 2)[0]) for d, s in stats.items()}
    want = {d: 0.99 * np.interp(r, centre, steps) + 0.01 * (r + 1) / 3 for d, r in raw.items()}
    got = {r.doc_id: r.score for r in queries.op1_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6

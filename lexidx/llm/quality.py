"""Quality scores: kernel ridge on document statistics.

Each text is reduced to a fixed vector of statistics (lengths, byte classes,
repetition of words, word pairs and lines). Random Fourier features of the
standardised vector approximate a Gaussian kernel. Every partition of training
rows sums its part of the normal equations, one sum for each fold; the sums are
added up by Spark and the small ridge systems solved. Scores of rows outside
the folds that made them are calibrated by isotonic regression over a fixed
grid of scores, so what reaches the driver has a size set by parameters alone.

Labels, language, source and id never enter a score; the id only decides which
labels may be learned from. The fit takes at most ``train_rows`` labelled rows.

Defined cases: null and empty texts have the statistics of an empty text and a
score like any other; very long texts are read whole; repeated rows each get
their score; a null id has no label and is not held out; without any usable
label every score is 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.llm.common import bounded_sample, discard, held_out, labels_of, per_batch, staged

TRAIN_ROWS = 200_000
FEATURES = 256
FOLDS = 3
RIDGE = 1.0
SEED = 20240229
GRID = 4000  # calibration bins in a unit of score
SYMBOLS = b"!?.,;:|*%&#$@+=<>{}[]()_\"'/\\~^-"


def _byte_classes() -> np.ndarray:
    cols = [np.zeros(256) for _ in range(7 + len(SYMBOLS))]
    for b in range(256):
        cols[0][b] = 65 <= b <= 90
        cols[1][b] = 97 <= b <= 122
        cols[2][b] = 48 <= b <= 57
        cols[3][b] = b == 32
        cols[4][b] = b in (10, 13)
        cols[5][b] = b >= 128
        cols[6][b] = b < 32 and b not in (9, 10, 13)
    for k, b in enumerate(SYMBOLS):
        cols[7 + k][b] = 1
    return np.stack(cols, axis=1)


_CLASSES = _byte_classes()
N_STATS = _CLASSES.shape[1] + 9


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one UTF-8 text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    words = text.split()
    lines = text.split(b"\n")
    w = len(words)
    out = np.empty(N_STATS)
    k = len(counts)
    out[:k] = np.sqrt(counts / max(n, 1))
    out[k] = np.log1p(n)
    out[k + 1] = np.log1p(w)
    out[k + 2] = np.log1p(n / max(w, 1))
    out[k + 3] = len(set(words)) / max(w, 1)
    out[k + 4] = len(set(zip(words, words[1:]))) / max(w - 1, 1)
    out[k + 5] = len(set(lines)) / max(len(lines), 1)
    out[k + 6] = np.log1p(n / max(len(lines), 1))
    out[k + 7] = np.log1p(max(map(len, words), default=0))
    out[k + 8] = sum(x[-1:].isalnum() for x in words) / max(w, 1)
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        flat = np.concatenate([statistics(t or b"") for t in texts]).astype(np.float32)
        offsets = np.arange(0, len(flat) + 1, N_STATS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "stats"])

    return src.mapInArrow(per_batch(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Model:
    """Standardisation, Fourier features, ridge weights and calibration; a few hundred KB."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.w = rng.normal(size=(d, features)) / np.sqrt(d) * 0.7
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray, beta: np.ndarray | None = None) -> np.ndarray:
        return np.clip(self.expand(stats) @ (self.beta if beta is None else beta), -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a small share of the ridge score so that plateaus keep its order."""
        raw = self.raw(stats)
        return 0.99 * np.interp(raw, *self.steps) + 0.01 * (raw + 1) / 3


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by ``x``: centres and values of the blocks."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([yi * wi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    s, w, c = np.array(blocks).T
    return c / w, s / w


def fit(features: DataFrame, labels: DataFrame, column: str = "quality", train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on the labelled rows of ``features`` (doc_id, stats) that are not held out; None without any."""
    spark = features.sparkSession
    written: list[str] = []
    chosen = bounded_sample(labels_of(labels, column), train_rows)
    train = staged(spark, features.where(~held_out()).join(chosen, "doc_id")
                   .select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "quality-train", written)

    def moments(batches):
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for batch in batches:
            x = _matrix(batch.column(0))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_STATS)), pa.array(np.full(N_STATS, n)), pa.array(s), pa.array(q)],
                                         ["j", "n", "s", "q"])

    rows = (train.select("stats").mapInArrow(moments, "j long, n long, s double, q double")
            .groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("j").collect())
    if not rows or not rows[0]["n"]:
        return None
    n = rows[0]["n"]
    mean = np.array([r["s"] for r in rows]) / n
    scale = np.sqrt(np.maximum(np.array([r["q"] for r in rows]) / n - mean**2, 0)) + 1e-6
    model = Model(mean, scale)
    width = len(model.beta)

    def equations(batches):  # this partition's Z'Z and Z'y, one row for each fold and row of the matrix
        gram, right = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for batch in batches:
            z, y, f = model.expand(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                zk = z[f == k]
                gram[k] += zk.T @ zk
                right[k] += zk.T @ y[f == k]
        flat = np.concatenate([gram, right[:, :, None]], axis=2).reshape(FOLDS * width, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS * width)), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width + 1).cast(pa.list_(pa.float64()))],
                                         ["row", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = _matrix(group.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"row": group.column("row")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = max(1, min(16, n // 4096))  # the training rows are bounded, so few partial sums will do
    summed = (train.coalesce(parts).mapInArrow(equations, "row long, sums array<double>")
              .groupBy("row").applyInArrow(add, "row long, sums array<double>").collect())
    all_sums = np.zeros((FOLDS * width, width + 1))
    for r in summed:
        all_sums[r["row"]] = r["sums"]
    all_sums = all_sums.reshape(FOLDS, width, width + 1)

    def solve(sums: np.ndarray) -> np.ndarray:
        penalty = RIDGE * np.eye(width)
        penalty[-1, -1] = 1e-9  # the intercept is free
        return np.linalg.solve(sums[:, :width] + penalty, sums[:, width])

    total = all_sums.sum(axis=0)
    model.beta = solve(total)
    without = [solve(total - all_sums[k]) for k in range(FOLDS)]

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = batch.column(2).to_numpy()
        stats = _matrix(batch.column(0))
        raw = np.zeros(len(f))
        for k in range(FOLDS):
            raw[f == k] = model.raw(stats[f == k], without[k])
        return pa.RecordBatch.from_arrays([pa.array(np.floor(raw * GRID).astype(np.int64)), batch.column(1)], ["bin", "y"])

    table = (train.mapInArrow(per_batch(binned), "bin long, y int").groupBy("bin")
             .agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect())  # 3 * GRID + 1 rows at most
    model.steps = isotonic(*(np.array([r[c] for r in table], float) for c in ("bin", "y", "n")))
    model.steps = ((model.steps[0] + 0.5) / GRID, model.steps[1])
    discard(spark, written)
    return model


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    features = staged(docs.sparkSession, with_statistics(docs), "quality-stats")
    return _scored(features, fit(features, labels, column, train_rows)).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _scored(features: DataFrame, model: Model | None) -> DataFrame:
    """``features`` with a score in place of the statistics."""
    if model is None:
        return features.drop("stats").withColumn("score", F.lit(0.5))
    names = [c for c in features.columns if c != "stats"]
    at = features.columns.index("stats")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*cols, pa.array(model.score(_matrix(batch.column(at))))], [*names, "score"])

    schema = features.drop("stats").withColumn("score", F.lit(0.0)).schema
    return features.mapInArrow(per_batch(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is at least ``threshold``.

    The texts are read twice: once to fit, once to score and filter row by row, so no text is shuffled.
    """
    written: list[str] = []
    features = staged(docs.sparkSession, with_statistics(docs, id_col, text_col), "quality-stats", written)
    model = fit(features, labels, train_rows=train_rows)
    discard(docs.sparkSession, written)
    if model is None:
        return docs
    t = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(t).to_pylist()
        stats = np.stack([statistics((x or "").encode()) for x in texts]).astype(np.float32).astype(np.float64)
        return batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(per_batch(run), docs.schema)

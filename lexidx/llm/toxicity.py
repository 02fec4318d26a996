"""Toxicity by a classifier chain.

Categories are predicted one after the other; the probability of each earlier
category is a feature of the later linear models. While training, those
probabilities are out of fold: rows of a fold get them from models that never
saw the fold, so later models learn from what they will meet.

The given label says toxic or not. The two categories before it are toxic rows
that hold a word of a fixed list (``insult``: words for a person; ``contempt``:
words for a thing); the last category is the label itself.

Features are presence of words and word beginnings. Which ones is learned: one
pass counts, for the training rows, in how many toxic and other texts each
occurs (hashed, pre-aggregated in each partition); the ``terms`` with the largest
excess are kept. The fit takes at most ``train_rows`` labelled rows, so their
ids can be broadcast and their short feature rows collected: both bounded by
parameters. Scoring is one narrow pass over all texts.

Defined cases: null and empty texts have no term and a score like any other;
very long texts are read whole; repeated rows each get their score; a null id
is never learned from; without toxic or without other labels all probabilities
are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.llm.common import Shipped, bounded_sample, held_out, labels_of, sliced, staged

TRAIN_ROWS = 30_000
TERMS = 256
FOLDS = 3
LEAST_TOXIC = 3  # texts a term must occur in
PREFIXES = (4, 5, 6, 7)
RIDGE = 1.0
CATEGORIES = ("insult", "contempt", "toxic")

# The words that name the first two categories.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "stupid"),
    "contempt": ("trash", "worthless", "pathetic", "disgusting"),
}
_WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Words of a text to hashed terms (the word, and its beginnings); remembers words up to a bound."""

    MEMORY = 200_000

    def __init__(self, only: dict[int, int] | None = None):
        import xxhash
        self.hash, self.only, self.memory = xxhash.xxh64_intdigest, only, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        names = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
        codes = [self.hash(x) >> 1 for x in names]
        if self.only is not None:
            codes = [self.only[c] for c in codes if c in self.only]
        return tuple(codes)

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        memory = self.memory
        for w in set(_WORD.findall(text.lower())) if text else ():
            codes = memory.get(w)
            if codes is None:
                if len(memory) >= self.MEMORY:
                    memory.clear()
                codes = memory[w] = self.of_word(w)
            out.update(codes)
        return out


def _category_flags(text: str | None) -> list[bool]:
    words = set(_WORD.findall(text.lower())) if text else set()
    return [not words.isdisjoint(CATEGORY_WORDS[c]) for c in CATEGORIES[:-1]]


def choose_terms(train: DataFrame, terms: int = TERMS) -> list[int]:
    """Hashes of the terms whose share among toxic texts exceeds that among others by most standard errors."""
    def counted(batches):
        of, hashes, toxic, rows = Terms(), [], [], [0, 0]
        for batch in sliced(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = of(text)
                hashes.append(np.fromiter(found, np.int64, len(found)))
                toxic.append(np.full(len(found), y, np.int64))
                rows[y] += 1
        if not hashes:
            return
        values, where = np.unique(np.concatenate(hashes), return_inverse=True)
        pos = np.bincount(where, weights=np.concatenate(toxic), minlength=len(values)).astype(np.int64)
        every = np.bincount(where, minlength=len(values)).astype(np.int64)
        # The term -1 carries the numbers of texts.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(values, -1)), pa.array(np.append(pos, rows[1])), pa.array(np.append(every - pos, rows[0]))],
            ["term", "pos", "neg"])

    counts = train.mapInArrow(counted, "term long, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") >= LEAST_TOXIC) | (F.col("term") == -1))
    counts = staged(train.sparkSession, counts, "toxicity-terms")
    both = counts.where("term = -1").collect()
    if not both or not both[0]["pos"] or not both[0]["neg"]:
        return []
    n_pos, n_neg = float(both[0]["pos"]), float(both[0]["neg"])
    share = (F.col("pos") + F.col("neg")) / F.lit(n_pos + n_neg)
    excess = ((F.col("pos") / F.lit(n_pos) - F.col("neg") / F.lit(n_neg))
              / F.sqrt(share * (1 - share) * F.lit(1 / n_pos + 1 / n_neg) + F.lit(1e-12)))
    return [r["term"] for r in counts.where("term >= 0")
            .select("term", excess.alias("excess")).where("excess > 3").orderBy(F.desc("excess"), "term").limit(terms).collect()]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last column of x is the intercept."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """One linear model per category over terms, the number of terms met, and the earlier probabilities."""

    def __init__(self, terms: list[int]):
        self.terms = {t: j for j, t in enumerate(terms)}
        self.betas: list[np.ndarray] = []

    def features(self, found: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(found), len(self.terms) + 1), np.float32)
        for r, js in enumerate(found):
            x[r, js] = 1
            x[r, -1] = np.log1p(len(js))
        return x

    @staticmethod
    def _with(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([x, *earlier, np.ones(len(x))])

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        earlier: list[np.ndarray] = []
        for k in range(y.shape[1]):
            z = self._with(x, earlier)
            self.betas.append(logistic(z, y[:, k]))
            outside = np.zeros(len(z))
            for f in range(FOLDS):
                rest = fold != f
                if (~rest).any():
                    beta = logistic(z[rest], y[rest, k]) if rest.any() else self.betas[-1]
                    outside[~rest] = sigmoid(z[~rest] @ beta)
            earlier.append(outside)

    def predict(self, x: np.ndarray) -> list[np.ndarray]:
        earlier: list[np.ndarray] = []
        for beta in self.betas:
            earlier.append(sigmoid(self._with(x, earlier) @ beta))
        return earlier


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS, terms: int = TERMS) -> Chain | None:
    """The chain, or None where the labelled rows hold only one class."""
    chosen = bounded_sample(labels_of(labels, "toxic"), train_rows)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most train_rows pairs of an id and a flag are broadcast: no text is shuffled.
    train = src.join(F.broadcast(chosen), "doc_id").select(
        "text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    kept = choose_terms(train.select("text", "y"), terms)
    if not kept:
        return None
    chain = Chain(kept)
    shipped = docs.sparkSession.sparkContext.broadcast(chain.terms)

    def featured(batches):
        of = Terms(shipped.value)
        for batch in sliced(batches):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(of(t)) for t in texts], pa.list_(pa.int32())), batch.column(1), batch.column(2),
                 pa.array([_category_flags(t) for t in texts], pa.list_(pa.bool_()))], ["found", "y", "fold", "flags"])

    rows = train.mapInArrow(featured, "found array<int>, y int, fold int, flags array<boolean>")
    # Short rows, at most train_rows of them even where labelled ids repeat; the same ones on every run.
    rows = rows.orderBy(F.xxhash64("fold", "y", "found", "flags"), "fold", "y", "found").limit(train_rows).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    flags = np.array(rows.column("flags").to_pylist(), float).reshape(len(y), -1)
    chain.fit(chain.features(rows.column("found").to_pylist()), np.column_stack([flags * y[:, None], y]), rows.column("fold").to_numpy())
    return chain


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS, terms: int = TERMS) -> DataFrame:
    """(doc_id, held_out, p_insult, p_contempt, score, predicted) for every row; ``score`` is the chain's last probability."""
    chain = fit(docs, labels, id_col, text_col, train_rows, terms)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = src.select("doc_id", held_out().alias("held_out"), "text")
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
              "p_insult double, p_contempt double, score double, predicted int")
    shipped = Shipped(docs.sparkSession, chain)

    def run(batches):
        model = shipped.value
        of = Terms(model.terms) if model else None
        for batch in sliced(batches):
            if model:
                found = [sorted(of(t)) for t in batch.column(2).to_pylist()]
                p = model.predict(model.features(found))
            else:
                p = [np.zeros(batch.num_rows)] * len(CATEGORIES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c) for c in p), pa.array((p[-1] >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "p_insult", "p_contempt", "score", "predicted"])

    return kept.mapInArrow(run, schema)

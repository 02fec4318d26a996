"""Benchmark decontamination: pairs of near words as seeds, then Smith-Waterman alignment.

1. A leak is a Smith-Waterman alignment of an item's L words with a passage (match
   2, mismatch -1, gap -1) whose score is at least ``least`` of the perfect 2L; call
   the lowest such score t. With m matches and e errors 2m - e >= t, so of the m - 1
   steps from a match to the next at most m - ceil(t / 2) hold two errors or more,
   and at least ceil(t / 2) - 1 hold one or none. Such a step ties a word of the
   item to one of the two words after it, and so it does in the text. Hence a leak
   touches at least ceil(t / 2) - 1 places of the item (words that start such a
   pair), all in at most 3L - t words of the text, however the copy was edited.
2. A pass over the whole corpus counts in how many texts each pair of the items
   occurs (at most two rows per word of the items). An item's seeds are its places
   but for the most frequent ones; half of the number a leak needs may be left
   out, so a text has to touch the other half among the seeds.
3. A second pass joins texts to items through the seeds by hash look-up. Stretches
   of the text that touch enough places of the item are aligned with it, word by
   word. No score of ``least`` goes unseen.

Texts never move: items travel to them in blocks of at most ``BLOCK_WORDS``
words, each block with passes of its own, so the broadcast has a fixed bound
however large the benchmark is.

Words are runs of letters, digits and underscores, lower-cased. Defined cases:
null, empty and wordless texts and items match nothing; very long texts are
read whole, passage by passage; several copies of an item in one text give one
row with the best of them (ties: the first); items so short that one matching word
reaches ``least`` (one or two words at 0.4) use their single words as seeds;
repeated items or rows each count; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.llm.common import Shipped, per_batch, sliced

LEAST = 0.4
BLOCK_WORDS = 2_000_000
LEAST_WORDS = 5  # of an item whose leaks take a document out
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grouped(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values by key: those of key j lie from starts[j] to starts[j + 1]."""
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)))), values[np.argsort(keys, kind="stable")]


def _of(keys: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the keys, and for each the place of its key in ``keys``."""
    n = starts[keys + 1] - starts[keys]
    source = np.repeat(np.arange(len(keys)), n)
    return values[np.arange(len(source)) + np.repeat(starts[keys] - np.cumsum(n) + n, n)], source


class Items:
    """A block of test items with the pairs at their places; what is shipped to the texts.

    Words of the items have codes from 1; a pair is the number its codes spell in
    base (words + 1), which fits 64 bits for blocks of BLOCK_WORDS; a single word is
    its code. Places are numbered through all items.
    """

    def __init__(self, rows: list[tuple[int, str]], least: float = LEAST):
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.code: dict[str, int] = {}
        for ws in words:
            for w in ws:
                self.code.setdefault(w, len(self.code) + 1)
        self.base = len(self.code) + 1
        self.coded = [self.encode(ws) for ws in words]
        full = [MATCH * len(c) for c in self.coded]
        lowest = [next((s for s in range(max(0, int(least * f) - 1), f + 1) if s / f >= least), f + 1) if f else 0 for f in full]
        steps = [-(-t // 2) - 1 for t in lowest]
        self.needed = np.array([max(1, n) for n in steps], np.int64)
        self.reach = [3 * len(c) - t for c, t in zip(self.coded, lowest, strict=True)]
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in self.coded]))).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(c) for c in self.coded])
        keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (c, n) in enumerate(zip(self.coded, steps, strict=True)):
            for apart in (1, 2) if n > 0 else (0,):
                keys.append(self._keys(c, apart))
                places.append(self.first[k] + np.arange(len(keys[-1])))
        keys, places = np.concatenate(keys), np.concatenate(places)
        self.keys, number = np.unique(keys, return_inverse=True)
        self.singles = bool((keys < self.base).any())
        self.starts, self.places = _grouped(number, places, len(self.keys))
        self.key_starts, self.numbers = _grouped(places, number, len(self.owner))
        self._own: dict[int, tuple] = {}  # what touched() needs of an item, once an item of the block is asked for

    def encode(self, words: list[str]) -> np.ndarray:
        """Codes of the words, 0 for words of no item."""
        return np.fromiter(map(self.code.get, words, repeat(0)), np.int64, len(words))

    def _keys(self, coded: np.ndarray, apart: int) -> np.ndarray:
        return coded[:len(coded) - apart] * self.base + coded[apart:] if apart else coded

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the items' pairs in a text, in order of position."""
        at, numbers = [], []
        for apart in (0, 1, 2) if self.singles else (1, 2):
            if len(coded) <= apart or not len(self.keys):
                continue
            known = np.flatnonzero((coded[:len(coded) - apart] > 0) & (coded[apart:] > 0))
            mine = self._keys(coded, apart)[known]
            k = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
            same = self.keys[k] == mine
            at.append(known[same])
            numbers.append(k[same])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, numbers = np.concatenate(at), np.concatenate(numbers)
        order = np.argsort(at, kind="stable")
        return at[order], numbers[order]

    def _places(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of item k's pairs, and its places by pair."""
        lo, hi = self.key_starts[self.first[k]], self.key_starts[self.first[k + 1]]
        own = np.repeat(np.arange(len(self.coded[k])), np.diff(self.key_starts[self.first[k]:self.first[k + 1] + 1]))
        mine, local = np.unique(self.numbers[lo:hi], return_inverse=True)
        return mine, *_grouped(local, own, len(mine))

    def touched(self, k: int, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of a text that touch places of item k, in order, and the places."""
        if k not in self._own:
            self._own[k] = self._places(k)
        mine, starts, places = self._own[k]
        j = np.minimum(np.searchsorted(mine, numbers), len(mine) - 1)
        same = mine[j] == numbers
        places, source = _of(j[same], starts, places)
        return at[same][source], places


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word codes: best score, start and end (exclusive) in the passage.

    One row of the table for each item word; gaps along the passage come from a
    running maximum, which is exact for a linear gap cost.
    """
    m = len(passage)
    steps = np.arange(1, m + 1) * GAP
    score = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        here = np.maximum(np.maximum(diagonal, up), 0)
        begun = np.where(here == diagonal, start[:-1], np.where(here == up, start[1:], np.arange(1, m + 1)))
        begun = np.where(here == 0, np.arange(1, m + 1), begun)
        lifted = here - steps  # along the row a gap costs the same everywhere
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(m), 0))
        along = peak + steps
        begun = np.where(along > here, begun[source], begun)
        here = np.maximum(here, along)
        score = np.concatenate(([0], here))
        start = np.concatenate(([0], begun))
        top = int(here.argmax())
        if here[top] > best[0]:
            best = (int(here[top]), int(begun[top]), top + 1)
    return best


class Finder:
    """Matches texts with a block of items, given how many texts hold each of their pairs."""

    def __init__(self, items: Items, counts: np.ndarray, least: float):
        self.items, self.least = items, least
        # A place is as frequent as its pairs together; each item leaves out its most frequent ones.
        often = np.bincount(np.repeat(np.arange(len(items.owner)), np.diff(items.key_starts)), counts[items.numbers], len(items.owner))
        left_out = items.needed // 2
        order = np.lexsort((-often, items.owner))
        seed = np.empty(len(order), bool)
        seed[order] = np.arange(len(order)) - items.first[items.owner] >= left_out[items.owner]
        self.least_seeds = items.needed - left_out
        numbers = np.repeat(np.arange(len(items.keys)), np.diff(items.starts))
        kept = seed[items.places]
        self.starts, self.seeds = _grouped(numbers[kept], items.places[kept], len(items.keys))

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) of every item that leaks into the text."""
        items = self.items
        coded = items.encode(words_of(text))
        at, numbers = items.hits(coded)
        if not len(at):
            return []
        seeds = np.unique(_of(np.unique(numbers), self.starts, self.seeds)[0])
        ks, n = np.unique(items.owner[seeds], return_counts=True)
        out = []
        for k in ks[n >= self.least_seeds[ks]].tolist():
            full = MATCH * len(items.coded[k])
            best = (0.0, 0, 0)
            for lo, hi in self._passages(k, *items.touched(k, at, numbers), len(coded)):
                s, b, e = align(items.coded[k], coded[lo:hi])
                if s / full > best[0]:
                    best = (s / full, lo + b, lo + e)
            if best[0] >= self.least:
                out.append((k, *best))
        return out

    def _passages(self, k: int, at: np.ndarray, places: np.ndarray, n_words: int) -> list[tuple[int, int]]:
        """Stretches of the text around windows that touch enough distinct places of the item."""
        reach, need = self.items.reach[k], int(self.items.needed[k])
        if (np.arange(1, len(at) + 1) - np.searchsorted(at, at - reach) < need).all():
            return []
        inside: dict[int, int] = defaultdict(int)
        spans: list[list[int]] = []
        left = 0
        at, places = at.tolist(), places.tolist()
        for p, j in zip(at, places, strict=True):
            inside[j] += 1
            while at[left] < p - reach:
                old = places[left]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                left += 1
            if len(inside) >= need:
                lo, hi = max(0, p - reach), min(n_words, p + reach)
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 8 * reach:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
        return [(lo, hi) for lo, hi in spans]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, least_words: int = 1):
    """The items of ``least_words`` words or more in blocks of at most BLOCK_WORDS words, streamed to the driver one block at a time.

    Words are counted as characters over two, an upper bound.
    """
    rows = (benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
            .where(F.col("i").isNotNull() & F.col("t").isNotNull()).orderBy("i", "t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if len(words_of(r["t"])) < least_words:
            continue
        words = len(r["t"]) // 2 + 1
        if block and size + words > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += words
    if block:
        yield block


def _finder(docs: DataFrame, items: Items, least: float, text_col: str) -> Finder:
    """Count the items' pairs over all texts, from which each item's seeds follow."""
    shipped = Shipped(docs.sparkSession, items)

    def counted(batches):
        block, total = shipped.value, defaultdict(int)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                for j in np.unique(block.hits(block.encode(words_of(text)))[1]).tolist():
                    total[j] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(len(items.keys), np.int64)
    counts[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return Finder(items, counts, least)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): one row for each item that leaks into a document."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id long, score double, "
              "start_word int, end_word int")
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        shipped = Shipped(spark, _finder(docs, Items(block, least), least, text_col))

        def run(batch: pa.RecordBatch, shipped=shipped) -> pa.RecordBatch:
            find = shipped.value
            rows, found = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                for f in find(text):
                    rows.append(r)
                    found.append(f)
            cols = list(zip(*found)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([find.items.ids[k] for k in cols[0]], pa.int64()),
                 pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                ["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.unionByName(src.mapInArrow(per_batch(run), schema))
    return out


def short_items(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The items that ``drop_leaks`` leaves aside: a few common words would take out every text that has them."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([len(words_of(x)) < least_words for x in batch.column(1).to_pylist()], pa.bool_()))
    src = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return src.mapInArrow(per_batch(run), "item_id long, text string")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = LEAST, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, unchanged, into which no test item of ``least_words`` words or more leaks.

    Shorter items (``short_items``) take no document out; ``leaks`` reports them like all others.
    """
    t = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text", least_words):
        shipped = Shipped(docs.sparkSession, _finder(docs, Items(block, least), least, text_col))

        def run(batch: pa.RecordBatch, shipped=shipped) -> pa.RecordBatch:
            find = shipped.value
            return batch.filter(pa.array([not find(x) for x in batch.column(t).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(per_batch(run), docs.schema)
    return docs

"""Periodic runs in texts: Lyndon arrays from suffix grouping, roots extended into runs.

A run is a stretch of words that has a smallest period q, is at least ``times``
periods and ``least`` words long, and cannot be extended without losing that
period. Every run holds a Lyndon root: a stretch of q words that is the longest
Lyndon word at its start, under the order of the words or under its reverse. So

1. the first phase of the suffix sorter (``lyndon.grouping``) gives the Lyndon
   arrays of a text under both orders;
2. positions whose Lyndon word is followed by a copy of itself are candidates (compared
   by running sums of word codes, all at once);
3. a candidate is extended to both sides as long as words one period apart agree;
   a stretch that is long enough is a run. Candidates inside a run of their
   own period are skipped, so a run is extended once for each order.

A text in which no stretch of least * (times - 1) / times words occurs twice holds
no such run, so it is not sorted. One narrow pass; each text is worked
on by itself, in time linear in its length but for the extension of nested runs.

Defined cases: null, empty and wordless texts have no words and no runs; a very
long text is read whole; rows that repeat an id each get their row; a null id
gets its row (and is never looped); an empty table gives no rows; columns besides id and text are
ignored. Ties between runs of equal exponent go to the smaller start, then period.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.llm.common import sliced
from lexidx.llm.lyndon import grouping

LEAST = 24
TIMES = 3
BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _sums(codes: np.ndarray) -> np.ndarray:
    """sums[k]: the first k words as one number; equal stretches at i and j differ by the factor BASE**(j-i)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(BASE, len(codes)), dtype=np.uint64)])


def may_repeat(codes: np.ndarray, sums: np.ndarray, width: int) -> bool:
    """False only if all stretches of ``width`` words are different."""
    n = len(codes) - width + 1
    if n < 2:
        return False
    names = np.sort((sums[width:] - sums[:n]) * _powers(pow(BASE, -1, _WORD), n))
    return bool((names[1:] == names[:-1]).any())


def _agree_right(codes: np.ndarray, at: int, period: int) -> int:
    """The first j >= at with codes[j] != codes[j + period], or the last j that has a partner, plus one."""
    n, step = len(codes) - period, 64
    while at < n:
        m = min(step, n - at)
        differ = codes[at:at + m] != codes[at + period:at + period + m]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + m, step * 2
    return n


def _agree_left(codes: np.ndarray, at: int, period: int) -> int:
    """The smallest j <= at such that codes[x] == codes[x + period] for all x from j to at - 1."""
    step = 64
    while at > 0:
        m = min(step, at)
        differ = (codes[at - m:at] != codes[at - m + period:at + period])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = at - m, step * 2
    return 0


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``times`` (3 or more) periods and ``least`` words, by start and period."""
    if times < 3:
        raise ValueError("a run must be asked to have three periods at least")
    n = len(codes)
    if n < max(least, times):
        return []
    sums = _sums(codes)
    if not may_repeat(codes, sums, max(1, -(-least * (times - 1) // times))):
        return []
    powers, found = _powers(BASE, n + 1), set()
    for symbols in (codes, codes.max() - codes):
        period = np.array(grouping(symbols)[0], np.int64)
        at = np.flatnonzero(np.arange(n) + 2 * period <= n)
        p = period[at]
        same = (sums[at + p] - sums[at]) * powers[p] == sums[at + 2 * p] - sums[at + p]
        at, p = at[same], p[same]
        by = np.lexsort((at, p))
        known = (0, 0, 0)
        for i, q in zip(at[by].tolist(), p[by].tolist()):
            if known[2] == q and i + 2 * q <= known[1]:
                continue
            start, end = _agree_left(codes, i, q), _agree_right(codes, i, q) + q
            if end - i >= 2 * q:
                known = (start, end, q)
                if end - start >= max(least, times * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(words: list[bytes], doc_id: int) -> list[bytes]:
    """One document in ten, by the crc32 of its id, repeats a stretch of its words up to its end."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a:a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[:n - a]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
              loops: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and its words without the repeats, joined by one space.

    Words are stretches without space and 09-0D. A word is a repeat if some run holds it after the
    run's first period. ``loops`` first makes one document in ten periodic (see ``looped``).
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in sliced(batches):
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split() if text else []
                if loops and doc_id is not None:
                    words = looped(words, doc_id)
                numbers = {}
                codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                own = runs_of(codes, least, times)
                if own:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in own:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    words_left = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                else:
                    words_left = words
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(words_left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best, run):  # runs come by start and period, so the first of equal exponents stays
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                     F.concat(r["period"].cast("string"), F.lit("\n")))))
    best = F.col("best")
    return (found.withColumn("best", F.aggregate("runs", none, better))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                    best["period"].alias("period"), F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))

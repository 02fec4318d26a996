"""Block maxima: top-k retrieval that reads only the blocks that can hold a hit (Q3).

Document ids are cut into blocks of ``BLOCK`` consecutive ids, the same for all terms.
For every (field, term, block) the index keeps the largest contribution of the
term to a score, without its idf. Summed over the terms of a query this bounds every score in a block.

A query finds a threshold in two phases: the k-th largest single contribution of
different blocks is a score that k documents reach; then the blocks of the largest
bounds are scored exactly and may raise it. Only blocks whose bound reaches
the threshold are read for the result, which equals that of scoring every
posting, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidx.functions import bm25
from lexidx.operators.ordered import new_key

BLOCK = 256
FIRST_BLOCKS = 64      # scored exactly to raise the threshold
RANGES = 32            # ranges of document ids pushed into the scan
LISTED_BLOCKS = 100_000  # block numbers broadcast at most; beyond, the ranges alone select
SLACK = 1 - 1e-9       # bounds and scores are sums in different orders


def block_of(doc_id: Column) -> Column:
    return F.floor(doc_id / F.lit(BLOCK)).cast("long")


def _impacts(postings: DataFrame, stats: DataFrame) -> DataFrame | None:
    """``postings`` of the text fields with each one's contribution; None without a text field. The average lengths are the index's, one row for each field."""
    lengths = {r["field"]: r["avg_length"] for r in stats.select("field", "avg_length").collect()}
    if not lengths:
        return None
    average = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])[F.col("field")]
    impact = bm25.term_score(F.lit(1.0), F.col("tf").cast("double"), F.col("dl").cast("double"), average)
    return postings.where(F.col("dl").isNotNull()).withColumn("block", block_of(F.col("doc_id"))).withColumn("impact", impact)


def _no_blocks(postings: DataFrame) -> DataFrame:
    return postings.select("field", "term", block_of(F.col("doc_id")).alias("block"), F.lit(0.0).alias("impact"),
                           F.lit(0).cast("long").alias("postings")).where("false")


def block_table(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, term, block, impact, postings) of the text fields."""
    rows = _impacts(postings, stats)
    if rows is None:
        return _no_blocks(postings)
    return rows.groupBy(*BLOCK_KEYS).agg(F.max("impact").alias("impact"), F.count(F.lit(1)).alias("postings"))


BLOCK_KEYS = ("field", "term", "block")
PIECE_SCHEMA = "field string, term string, block long, impact double, postings long, end boolean"


def piece_blocks(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """The blocks in each piece that is read of files sorted by field, term and document, of disjoint ranges (``layout.deal``).

    A block's postings lie next to each other, so a piece is merged as it is read. Only its first and its last block
    (``end``) may have rows in another piece.
    """
    rows = _impacts(postings, stats)
    if rows is None:
        return _no_blocks(postings).withColumn("end", F.lit(True))
    piece = F.xxhash64("_metadata.file_name", "_metadata.file_block_start")
    rows = rows.select(piece.alias("piece"), *BLOCK_KEYS, "impact", F.lit(1).cast("long").alias("postings"))

    def run(batches):
        held, held_first = None, True  # the last block so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new_piece = new_key(t.column("piece"), None)
            new_piece[0] = True
            starts = np.flatnonzero(np.logical_or.reduce([new_piece, *(new_key(t.column(k), None) for k in BLOCK_KEYS)]))
            first = new_piece[starts]
            first[0] = held_first
            impact = np.maximum.reduceat(t.column("impact").to_numpy(), starts)
            count = np.add.reduceat(t.column("postings").to_numpy(), starts)
            keys = t.select(["piece", *BLOCK_KEYS]).take(pa.array(starts))
            out = pa.RecordBatch.from_arrays([*keys.columns, pa.array(impact), pa.array(count)], schema=t.schema)
            held, held_first = out.slice(len(starts) - 1), bool(first[-1])
            done = out.slice(0, len(starts) - 1)
            yield pa.RecordBatch.from_arrays([*done.columns[1:], pa.array(first[:-1] | first[1:], pa.bool_())], [*done.schema.names[1:], "end"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns[1:], pa.array([True])], [*held.schema.names[1:], "end"])

    return rows.mapInArrow(run, PIECE_SCHEMA)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """``block_table`` from ``piece_blocks``: of each piece only the first and the last block are exchanged."""
    ends = pieces.where("end").groupBy(*BLOCK_KEYS).agg(F.max("impact").alias("impact"), F.sum("postings").alias("postings"))
    return pieces.where("not end").drop("end").unionByName(ends)


@dataclass
class Selection:
    """Postings of a query's terms in the blocks that can matter, and how much that leaves out."""
    postings: DataFrame
    threshold: float
    blocks: int
    of_blocks: int
    expected_postings: int
    of_postings: int


def _in_blocks(postings: DataFrame, chosen: DataFrame, ranges: list, count: int) -> DataFrame:
    near = F.lit(False)
    for lo, hi in ranges:
        near = near | F.col("doc_id").between(lo * BLOCK, hi * BLOCK + BLOCK - 1)
    found = postings.where(near)
    if count > LISTED_BLOCKS:
        return found  # whole ranges: more postings than needed, same result
    return found.join(F.broadcast(chosen), block_of(F.col("doc_id")) == F.col("block"), "left_semi")


def _ranges(chosen: DataFrame, lo: int, hi: int) -> list[tuple[int, int]]:
    """At most RANGES ranges of block numbers around the chosen ones."""
    width = max(1, -(-(hi - lo + 1) // RANGES))
    rows = chosen.groupBy(F.floor((F.col("block") - lo) / F.lit(width)).alias("cell")).agg(
        F.min("block").alias("lo"), F.max("block").alias("hi")).collect()
    return sorted((r["lo"], r["hi"]) for r in rows)


def select(postings: DataFrame, blocks: DataFrame, weights: DataFrame, field: str, terms: list[str], k: int, scores) -> Selection:
    """The postings needed for the k best documents.

    ``weights`` (term, weight): one row for each query term, what a contribution is multiplied with; ``scores`` turns
    postings into (doc_id, score).
    """
    wanted = (F.col("field") == field) & F.col("term").isin(sorted(set(terms)))
    own = postings.where(wanted)
    bound = F.col("weight") * F.col("impact")
    per_block = (blocks.where(wanted).join(F.broadcast(weights), "term").groupBy("block")
                 .agg(F.sum(bound).alias("bound"), F.max(bound).alias("single"), F.sum("postings").alias("postings")))
    tops = per_block.orderBy(F.desc("bound"), "block").limit(max(FIRST_BLOCKS, k)).select(F.lit("bound").alias("of"), "block", F.col("bound").alias("x"))
    singles = per_block.orderBy(F.desc("single"), "block").limit(k).select(F.lit("single").alias("of"), "block", F.col("single").alias("x"))
    rows = tops.unionByName(singles).collect()
    reached = sorted((r["x"] for r in rows if r["of"] == "single"), reverse=True)
    first = sorted({r["block"] for r in rows if r["of"] == "bound"})
    threshold = reached[k - 1] if len(reached) >= k else float("-inf")
    if first:
        spark = postings.sparkSession
        chosen = spark.createDataFrame([(b,) for b in first], "block long")
        near = _in_blocks(own, chosen, merged(first), len(first))
        best = [r["score"] for r in scores(near).orderBy(F.desc("score")).limit(k).collect()]
        if len(best) >= k:
            threshold = max(threshold, best[-1])
    threshold = threshold * SLACK
    kept = per_block.where(F.col("bound") >= threshold)
    is_kept = F.col("bound") >= threshold
    c = per_block.agg(F.count(F.lit(1)).alias("all"), F.sum("postings").alias("all_postings"), F.count_if(is_kept).alias("n"),
                      F.sum(F.when(is_kept, F.col("postings"))).alias("postings"), F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    n = c["n"]
    ranges = _ranges(kept, c["lo"], c["hi"]) if n else []
    return Selection(_in_blocks(own, kept.select("block"), ranges, n), threshold, n, c["all"], c["postings"] or 0, c["all_postings"] or 0)


def merged(blocks: list[int]) -> list[tuple[int, int]]:
    """At most RANGES ranges that cover the sorted block numbers."""
    gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])[:RANGES - 1]
    cuts = [0, *sorted(gaps), len(blocks)]
    return [(blocks[x], blocks[y - 1]) for x, y in zip(cuts, cuts[1:])]

"""Which file a posting belongs to, decided from the term dictionary.

Files cover disjoint ranges of (field, term, doc_id) and hold about equally many
bytes. The dictionary says how many bytes each term takes, so the ranges follow
from its running sums and nothing has to be sampled from the postings
themselves. A term too large for one file is cut at quantiles of its document ids.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_BYTES = 128 << 20
LEAST_FILE_BYTES = 1 << 20
KEYS = ["field", "term", "doc_id"]


def term_bytes() -> Column:
    """About what a term's postings take in a file: its documents' ids, counts and lengths, and its positions."""
    return (F.lit(12) * F.col("doc_freq") + F.lit(4) * F.col("total_term_freq")).cast("long")


def _running_sums(terms: DataFrame) -> DataFrame:
    """``terms`` (files sorted by field and term, of disjoint ranges) with the bytes that come before each term.

    A file is summed by itself and starts from the sum of the files before it: one row for each file meets on the driver.
    """
    t = terms.select("field", "term", term_bytes().alias("bytes"), F.col("_metadata.file_path").alias("file"))
    files = (t.groupBy("file").agg(F.min(F.struct("field", "term")).alias("first"), F.sum("bytes").alias("bytes"))
             .orderBy("first").collect())
    before, offsets = 0, []
    for f in files:
        offsets.append((f["file"], before))
        before += f["bytes"]
    small = terms.sparkSession.createDataFrame(offsets, "file string, offset long")
    w = Window.partitionBy("file").orderBy("field", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.join(F.broadcast(small), "file").select(
        "field", "term", "bytes", (F.col("offset") + F.sum("bytes").over(w) - F.col("bytes")).alias("before"))


def file_starts(terms: DataFrame, postings: DataFrame, parallelism: int, file_bytes: int = FILE_BYTES,
                least_bytes: int = LEAST_FILE_BYTES) -> list[tuple]:
    """Sorted (field, term, doc_id or None) at which each file after the first begins.

    As many entries as there are files, so the list is bounded by the output. Files are
    ``file_bytes`` large, smaller where that would leave cores without work, but not below ``least_bytes``.
    """
    total = terms.agg(F.sum(term_bytes())).first()[0] or 0
    size = max(min(least_bytes, file_bytes), min(file_bytes, -(-total // max(1, parallelism))))
    if total <= size:
        return []
    sums = _running_sums(terms)
    cell = F.floor(F.col("before") / F.lit(size))
    starts = [(r["k"]["field"], r["k"]["term"], None)
              for r in sums.groupBy(cell.alias("cell")).agg(F.min(F.struct("field", "term")).alias("k")).where("cell > 0").collect()]
    large = {(r["field"], r["term"]): -(-r["bytes"] // size) for r in sums.where(F.col("bytes") > size).collect()}
    if large:
        most = max(large.values())
        names = terms.sparkSession.createDataFrame(list(large), "field string, term string")
        cuts = (postings.join(F.broadcast(names), ["field", "term"]).groupBy("field", "term")
                .agg(F.percentile_approx("doc_id", [i / most for i in range(1, most)], 10 * most).alias("at")).collect())
        for r in cuts:
            pieces = large[r["field"], r["term"]]
            at = {r["at"][min(most - 2, round(j * most / pieces) - 1)] for j in range(1, pieces)}
            starts += [(r["field"], r["term"], d) for d in at]
    return sorted(set(starts), key=lambda s: (s[0].encode(), s[1].encode(), s[2] is not None, s[2]))


def file_of(starts: list[tuple], id_type: str) -> Column:
    """The number of starts at or before (field, term, doc_id): a binary search over one constant."""
    if not starts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"field": f, "term": t, "doc_id": d} for f, t, d in starts])),
                        f"array<struct<field:string,term:string,doc_id:{id_type}>>")
    key = F.struct(*KEYS)
    steps = [1 << i for i in reversed(range(len(starts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def deal(postings: DataFrame, starts: list[tuple]) -> DataFrame:
    """``postings`` with each file's rows in a partition of their own, sorted: one exchange, no sampling."""
    id_type = postings.schema["doc_id"].dataType.simpleString()
    columns = postings.columns
    return (postings.withColumn("_file", file_of(starts, id_type)).repartitionById(len(starts) + 1, F.col("_file"))
            .select(*columns).sortWithinPartitions(*KEYS))

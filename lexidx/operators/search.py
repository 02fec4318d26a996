"""Lookups on built index tables (Q1-Q6).

Every lookup is a filter on a table laid out for Parquet row-group skipping
(postings by (field, term), points by value), and joins only tables whose
size is bounded by the query itself (query terms, one row per field).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidx.functions import bm25
from lexidx.operators import blockmax
from lexidx.operators.schema import column_of

QTERM_SCHEMA = T.StructType([T.StructField("term", T.StringType()),
                             T.StructField("qcount", T.LongType())])


def query_terms(spark: SparkSession, text: str, pattern: str | None = None) -> list[str]:
    """Analyse a query string with the documents' analyser (one tiny row)."""
    from lexidx.functions import analyzer
    row = spark.createDataFrame([(text,)], "q string").select(
        analyzer.tokens(F.col("q"), pattern or analyzer.DEFAULT_PATTERN).alias("t")).first()
    return list(row.t or [])


def term_lookup(post: DataFrame, field: str, term: str) -> DataFrame:
    """Q1/Q2: documents containing the exact (already analysed) term."""
    return post.where((F.col("field") == field) & (F.col("term") == term)).select("doc_id", "tf")


def _query_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    counts: dict[str, int] = {}
    for t in terms:
        counts[t] = counts.get(t, 0) + 1
    return spark.createDataFrame(sorted(counts.items()), QTERM_SCHEMA)


def bm25_scores(post: DataFrame, terms_df: DataFrame, stats: DataFrame,
                field: str, terms: list[str]) -> DataFrame:
    """Per matching document, the summed BM25 score of the query terms.

    ``terms_df`` is the term dictionary (field, term, doc_freq, ...);
    ``stats`` the field statistics (field, doc_count, avg_length).
    Sides joined by broadcast hold one row per distinct query term and one
    row per field, so their size is fixed by the query, not by the data.
    A repeated query term counts once per repetition.
    """
    return _scored(post, _term_weights(post.sparkSession, terms_df, stats, field, terms), field, terms)


def _term_weights(spark: SparkSession, terms_df: DataFrame, stats: DataFrame, field: str, terms: list[str]) -> DataFrame:
    """(field, term, qcount, avg_length, idf) of the query terms that the field has."""
    q = _query_terms(spark, terms)
    # N and avgdl: the field's single stats row, read once as two numbers
    # (a join on the constant field would plan as a nested-loop join, and two
    # scalar subqueries would compute the statistics twice).
    row = stats.where(F.col("field") == field).select("doc_count", "avg_length").first()
    n_docs = F.lit(float(row["doc_count"]) if row else 0.0)
    avgdl = F.lit(float(row["avg_length"]) if row else 1.0)
    return (terms_df.where((F.col("field") == field) & F.col("term").isin(list(set(terms))))
            .join(F.broadcast(q), "term")
            .select("field", "term", "qcount", avgdl.alias("avg_length"),
                    bm25.idf(n_docs, F.col("doc_freq").cast("double")).alias("idf")))


def _scored(post: DataFrame, st: DataFrame, field: str, terms: list[str]) -> DataFrame:
    hits = post.where((F.col("field") == field) & F.col("term").isin(list(set(terms))))
    scored = hits.join(F.broadcast(st), ["field", "term"]).select(
        "doc_id", (F.col("qcount") * bm25.term_score(
            F.col("idf"), F.col("tf").cast("double"), F.col("dl").cast("double"),
            F.col("avg_length"))).alias("s"))
    return scored.groupBy("doc_id").agg(F.sum("s").alias("score"))


def bm25_topk_version(tables, field: str, terms: list[str], k: int = 10) -> DataFrame:
    """Q3 on the tables of a published version (``index.read``): the postings and
    term statistics are read with the field and term filters pushed into the Parquet scans,
    and of the postings only the blocks that can hold one of the k best."""
    if tables.blocks is None:
        return bm25_topk(tables.postings, tables.terms(), tables.stats(), field, terms, k)
    scores, found = bm25_selection(tables, field, terms, k)
    return top_k(scores(found.postings), k)


def bm25_selection(tables, field: str, terms: list[str], k: int):
    """(postings -> scores, the selection of postings that the k best documents need)."""
    st = _term_weights(tables.postings.sparkSession, tables.terms(), tables.stats(), field, terms)
    known = st.collect()  # one row for each distinct query term
    st = tables.postings.sparkSession.createDataFrame(known, st.schema)

    def scores(post: DataFrame) -> DataFrame:
        return _scored(post, st, field, terms)

    weights = st.select("term", (F.col("qcount") * F.col("idf")).alias("weight"))
    return scores, blockmax.select(tables.postings, tables.blocks, weights, field, terms, k, scores)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25_topk_unindexed(docs: DataFrame, field: str, terms: list[str], k: int = 10,
                        pattern: str | None = None) -> DataFrame:
    """Q3 over a document table that has no index yet, in two passes.

    Pass 1 is one aggregate: N, the total length and the document frequency
    of each distinct query term (a fixed, small number of columns), read as
    one row. Pass 2 scores every document inside its row, then top-k.
    """
    from lexidx.functions import analyzer
    pattern = pattern or analyzer.DEFAULT_PATTERN
    uniq = sorted(set(terms))
    toks = analyzer.tokens(F.col(field), pattern)
    d = docs.where(F.col(field).isNotNull()).select(toks.alias("_t"))
    aggs = [F.count(F.when(F.size("_t") > 0, F.lit(1))).alias("n"),
            F.sum(F.size("_t")).alias("total")]
    aggs += [F.count(F.when(F.array_contains("_t", t), F.lit(1))).alias(f"df{i}") for i, t in enumerate(uniq)]
    row = d.agg(*aggs).first()
    n = float(row["n"] or 0)
    avgdl = float(row["total"] or 0) / n if n else 1.0
    counts = {t: terms.count(t) for t in uniq}
    # A document is one row with all its tokens, so its score is one
    # expression over them: no postings, no join, no shuffle before the top-k.
    d = docs.where(F.col(field).isNotNull()).select("doc_id", toks.alias("_t")).select(
        "doc_id", F.size("_t").cast("double").alias("_dl"),
        *[F.size(F.filter("_t", _equals(t))).cast("double").alias(f"_tf{i}") for i, t in enumerate(uniq)])
    total, found = F.lit(0.0), F.lit(False)
    for i, t in enumerate(uniq):
        w = counts[t] * bm25.idf(F.lit(n), F.lit(float(row[f"df{i}"] or 0)))
        tf = F.col(f"_tf{i}")
        total = total + F.when(tf > 0, w * bm25.term_score(F.lit(1.0), tf, F.col("_dl"), F.lit(avgdl))).otherwise(0.0)
        found = found | (tf > 0)
    return top_k(d.where(found).select("doc_id", total.alias("score")), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Q3: best k by score, ties by ascending doc id; rank from 1.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge); the rank window then runs over k rows only.
    """
    best = scores.orderBy(F.col("score").desc(), F.col("doc_id").asc()).limit(k)
    w = Window.orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return best.select(F.row_number().over(w).alias("rank"), "doc_id", "score")


def bm25_topk(post: DataFrame, terms_df: DataFrame, stats: DataFrame,
              field: str, terms: list[str], k: int = 10) -> DataFrame:
    return top_k(bm25_scores(post, terms_df, stats, field, terms), k)


FETCH_RANGES = 32


def id_ranges(ids: list[int], most: int = FETCH_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover the sorted ids, cut at the widest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[:most - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[x], ids[y - 1]) for x, y in zip(cuts, cuts[1:])]


def fetch_stored(hits: DataFrame, stored_df: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Q4: stored fields of the hits.

    A top-k hit list has at most ``max_hits`` rows. They are read once, and the
    stored table is filtered by a few ranges of ``doc_id`` around them: range
    predicates reach the Parquet scan whatever their number (long IN lists
    shrink to one range there), and stored files are in document order, so
    only row groups near a hit are read. Without ``max_hits``, a regular join.
    """
    if max_hits is None:
        return hits.join(stored_df, "doc_id")
    rows = hits.limit(max_hits + 1).collect()
    if len(rows) > max_hits:
        raise ValueError(f"more than {max_hits} hits")
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    near = F.lit(False)
    for lo, hi in id_ranges(ids) if ids else []:
        near = near | F.col("doc_id").between(lo, hi)
    small = hits.sparkSession.createDataFrame(rows, hits.schema)
    return F.broadcast(small).join(stored_df.where(near), "doc_id")


def fetch_version(tables, hits: DataFrame, max_hits: int) -> DataFrame:
    """Q4 on a published version: the table of locations names the files that hold the hits, and only these are
    opened, in whatever order the documents were stored. At most ``max_hits`` files, one look-up by ranges of ``doc_id``."""
    if tables.locations is None:
        return fetch_stored(hits, tables.stored, max_hits)
    spark = hits.sparkSession
    rows = hits.limit(max_hits + 1).collect()
    if len(rows) > max_hits:
        raise ValueError(f"more than {max_hits} hits")
    small = spark.createDataFrame(rows, hits.schema)
    found = fetch_stored(small.select("doc_id").distinct(), tables.locations, max_hits).select("file").distinct().collect()
    if not found:
        return fetch_stored(small, tables.stored.where("false"), max_hits)
    files = [f"{tables.path}/stored/{r['file']}" for r in found]
    return fetch_stored(small, spark.read.schema(tables.stored.schema).parquet(*files), max_hits)


def numeric_range(pts: DataFrame, field: str, lo=None, hi=None,
                  lo_inclusive: bool = True, hi_inclusive: bool = True) -> DataFrame:
    """Q5: documents whose point value lies in [lo, hi] (either end open)."""
    cond = F.col("field") == field
    v = F.col("value")
    if lo is not None:
        cond = cond & ((v >= lo) if lo_inclusive else (v > lo))
    if hi is not None:
        cond = cond & ((v <= hi) if hi_inclusive else (v < hi))
    return pts.where(cond).select("doc_id", "value")


def sort_by_field(stored_df: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Q6: documents ordered by a stored keyword/long/double field.

    Documents without the field sort last; ties by ascending doc id.
    A global ``orderBy`` is a range-partitioned sort, no single partition.
    """
    c = F.col(column_of(field))
    key = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return stored_df.orderBy(key, F.col("doc_id").asc())

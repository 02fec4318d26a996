"""Index build (B2-B11): stored, postings, points, terms and length tables.

Input is a typed document DataFrame: ``doc_id`` plus one column per field,
NULL meaning the field was omitted. Every table here is derived with native
expressions. Postings are grouped *inside each document row* (sort the
(term, position) pairs, cut them into runs), so building them needs no
shuffle at all; only the term dictionary shuffles, with a map-side partial
aggregate, so a term present in every document is no hot key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidx.functions import analyzer
from lexidx.operators import blockmax, layout as file_layout
from lexidx.operators.schema import Field, FieldType, column_of, fields_of
from lexidx.session import delete_path, scratch_path

POSTING_COLUMNS = ["field", "term", "doc_id", "tf", "positions", "dl"]


def _with_term_runs(df: DataFrame, toks: str, out: str) -> DataFrame:
    """Add ``out`` = ARRAY<STRUCT<term, tf, positions>> of the token array.

    The (term, position) pairs are sorted once, then cut into runs of equal
    term: O(n log n) per document. Each intermediate array is its own
    column, so the lambdas read a column instead of re-evaluating the sort.
    """
    # sort_array: the type's own ordering, no comparator lambda per compare.
    df = df.withColumn("_pairs", F.sort_array(F.transform(
        F.col(toks), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), asc=True))
    pairs = F.col("_pairs")
    df = df.withColumn("_starts", F.filter(
        F.transform(pairs, lambda x, i: i),
        lambda i: (i == 0) | (F.element_at(pairs, i + 1)["term"] != F.element_at(pairs, i)["term"])))
    starts, n = F.col("_starts"), F.size(pairs)

    def run(s, k):
        end = F.coalesce(F.try_element_at(starts, k + 2), n)
        return F.struct(
            F.element_at(pairs, s + 1)["term"].alias("term"),
            (end - s).cast("int").alias("tf"),
            F.transform(F.slice(pairs, s + 1, end - s), lambda x: x["pos"]).alias("positions"))
    return df.withColumn(out, F.transform(starts, run)).drop("_pairs", "_starts")


# Splits for each core beyond which enough of them are taken to hold rows.
SURE_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores (one small file) to every core,
    in ranges of ``doc_id``: document order is kept, and only task boundaries
    depend on the session, never a result. A table of many splits is left as it
    is, so no shuffle is added at scale, unless its rows lie in splits for fewer than half of the
    cores: a Parquet file of one row group has them all in one split, into however many it is cut.
    Meant for plain table scans."""
    par = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    few = splits < par
    if not few and splits <= SURE_SPLITS * par:
        # Footers only, no column is read.
        few = 2 * df.select(F.spark_partition_id().alias("split")).distinct().count() < par
    return df.repartitionByRange(par, "doc_id") if few else df


def text_postings(docs: DataFrame, field: str, pattern: str = analyzer.DEFAULT_PATTERN,
                  only_terms: list[str] | None = None) -> DataFrame:
    """B2: (field, term, doc_id, tf, positions, dl) of one text field.

    ``only_terms`` keeps the postings of those terms only (positions stay
    those of the full token stream): query-time scoring over documents that
    are not indexed yet needs no runs for the other terms.
    """
    toks = analyzer.tokens(F.col(column_of(field)), pattern)
    per_doc = docs.where(F.col(column_of(field)).isNotNull()).select("doc_id", toks.alias("toks"))
    if only_terms is not None:
        wanted = F.array(*[F.lit(t) for t in sorted(set(only_terms))])
        per_doc = per_doc.select("doc_id", F.size("toks").alias("_dl"), F.filter(
            F.transform("toks", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))),
            lambda x: F.array_contains(wanted, x["term"])).alias("_tp"))
        per_doc = per_doc.select("doc_id", "_dl", F.transform("_tp", lambda x: x["term"]).alias("toks"),
                                 F.transform("_tp", lambda x: x["pos"]).alias("_pos"))
        per_doc = _with_term_runs(per_doc, "toks", "runs")
        per_doc = per_doc.withColumn("runs", F.transform("runs", lambda r: F.struct(
            r["term"].alias("term"), r["tf"].alias("tf"),
            F.transform(r["positions"], lambda i: F.element_at(F.col("_pos"), i + 1)).alias("positions"))))
        return per_doc.select(
            F.lit(field).alias("field"), "doc_id", F.col("_dl").alias("dl"),
            F.explode_outer("runs").alias("p")).where(F.col("p").isNotNull()).select(
            "field", F.col("p.term").alias("term"), "doc_id", F.col("p.tf").alias("tf"),
            F.col("p.positions").alias("positions"), "dl")
    return run_postings(_text_runs(docs, field, pattern))


def _text_runs(docs: DataFrame, field: str, pattern: str) -> DataFrame:
    """(field, doc_id, dl, runs): each document's length in tokens and its terms, one row."""
    toks = analyzer.tokens(F.col(column_of(field)), pattern)
    per_doc = docs.where(F.col(column_of(field)).isNotNull()).select("doc_id", toks.alias("toks"))
    return _with_term_runs(per_doc, "toks", "runs").select(F.lit(field).alias("field"), "doc_id", F.size("toks").alias("dl"), "runs")


def run_postings(runs: DataFrame) -> DataFrame:
    """The postings in (field, doc_id, dl, runs)."""
    # explode_outer: a plain explode makes the optimizer infer a
    # size(runs) > 0 filter below this projection, which inlines the
    # sort into every lambda call (quadratic per document).
    return runs.select("field", "doc_id", "dl", F.explode_outer("runs").alias("p")).where(F.col("p").isNotNull()).select(
        "field", F.col("p.term").alias("term"), "doc_id", F.col("p.tf").alias("tf"),
        F.col("p.positions").alias("positions"), "dl")


def keyword_postings(docs: DataFrame, field: str, boolean: bool = False) -> DataFrame:
    """One un-analysed term per document; booleans as 'true'/'false'."""
    val = F.col(column_of(field))
    term = F.when(val, F.lit("true")).otherwise(F.lit("false")) if boolean else val
    return docs.where(val.isNotNull()).select(
        F.lit(field).alias("field"), term.alias("term"), "doc_id",
        F.lit(1).alias("tf"), F.lit(None).cast("array<int>").alias("positions"),
        F.lit(None).cast("int").alias("dl"))


def text_runs(docs: DataFrame, fields, pattern: str = analyzer.DEFAULT_PATTERN) -> DataFrame | None:
    """The runs of every text field; None without such a field."""
    parts = [_text_runs(docs, f.name, pattern) for f in fields_of(fields) if f.type is FieldType.TEXT]
    return reduce(DataFrame.unionByName, parts) if parts else None


def postings(docs: DataFrame, fields, pattern: str = analyzer.DEFAULT_PATTERN, runs: DataFrame | None = None) -> DataFrame:
    """All postings of every term-indexed field, one table; None without such a field.

    ``runs`` are the text fields' runs where they are at hand already.
    """
    parts = [] if runs is None else [run_postings(runs)]
    for f in fields_of(fields):
        if f.type is FieldType.TEXT:
            if runs is None:
                parts.append(text_postings(docs, f.name, pattern))
        elif f.type is FieldType.KEYWORD:
            parts.append(keyword_postings(docs, f.name))
        elif f.type is FieldType.BOOLEAN:
            parts.append(keyword_postings(docs, f.name, boolean=True))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def points(docs: DataFrame, fields, kind: FieldType) -> DataFrame:
    """(field, value, doc_id) of every long or double field."""
    parts = [docs.where(F.col(column_of(f.name)).isNotNull()).select(
        F.lit(f.name).alias("field"), F.col(column_of(f.name)).alias("value"), "doc_id")
        for f in fields_of(fields) if f.type is kind]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored(docs: DataFrame, fields) -> DataFrame:
    """The stored document table, keyed by doc_id."""
    return docs.select("doc_id", *[column_of(f.name) for f in fields_of(fields)])


def term_dictionary(post: DataFrame) -> DataFrame:
    """Per (field, term) document frequency and total term frequency."""
    return post.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_term_freq"))


def doc_lengths(docs: DataFrame, fields, pattern: str = analyzer.DEFAULT_PATTERN) -> DataFrame:
    """B9 norms: (field, doc_id, length) of every text field."""
    parts = [docs.where(F.col(column_of(f.name)).isNotNull()).select(
        F.lit(f.name).alias("field"), "doc_id",
        analyzer.token_count(F.col(column_of(f.name)), pattern).alias("length"))
        for f in fields_of(fields) if f.type is FieldType.TEXT]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_stats(lengths: DataFrame) -> DataFrame:
    """Per text field, docs having a term, sum and average of lengths.

    A document whose text yields no token does not count, as in an inverted
    index's per-field document count.
    """
    return lengths.where(F.col("length") > 0).groupBy("field").agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.sum("length").alias("sum_length"),
        (F.sum("length") / F.count(F.lit(1))).alias("avg_length"))


@dataclass
class IndexTables:
    """An index; a table that its fields do not call for is None.

    ``written_terms`` and ``written_stats`` are the term dictionary and field
    statistics of a published version; without them they are derived. ``blocks``
    are the block maxima of one, ``locations`` tells which file of its stored
    table (below ``path``) holds a document.
    """
    stored: DataFrame
    postings: DataFrame | None
    lengths: DataFrame | None
    long_points: DataFrame | None
    double_points: DataFrame | None
    written_terms: DataFrame | None = None
    written_stats: DataFrame | None = None
    blocks: DataFrame | None = None
    locations: DataFrame | None = None
    path: str | None = None

    def terms(self) -> DataFrame:
        return self.written_terms if self.written_terms is not None else term_dictionary(self.postings)

    def stats(self) -> DataFrame:
        return self.written_stats if self.written_stats is not None else field_stats(self.lengths)


def build(docs: DataFrame, fields, pattern: str = analyzer.DEFAULT_PATTERN) -> IndexTables:
    fl = fields_of(fields)
    has_text = any(f.type is FieldType.TEXT for f in fl)
    return IndexTables(
        stored=stored(docs, fl),
        postings=postings(docs, fl, pattern),
        lengths=doc_lengths(docs, fl, pattern) if has_text else None,
        long_points=points(docs, fl, FieldType.LONG),
        double_points=points(docs, fl, FieldType.DOUBLE),
    )


# ---- writing (B10, B11) -------------------------------------------------

TABLES = ("stored", "locations", "postings", "lengths", "long_points", "double_points", "terms", "field_stats", "blocks")


def _layout(df: DataFrame, keys: list[str], layout: str) -> DataFrame:
    """``local``: sort inside each task's files (no shuffle); ``range``:
    range-partition on the keys first, so files cover disjoint key ranges and
    whole files are skipped too (one extra shuffle at build time)."""
    if layout == "range":
        df = df.repartitionByRange(*keys)
    return df.sortWithinPartitions(*keys)


# Texts are written in row groups of this size, so that what reads them back spreads over all cores.
STORED_ROW_GROUP = 4 << 20


def _writer(df: DataFrame, max_records_per_file: int):
    return df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).option("compression", "zstd")


def _write_stored(df: DataFrame, path: str, max_records_per_file: int) -> None:
    _writer(df, max_records_per_file).option("parquet.block.size", STORED_ROW_GROUP).parquet(f"{path}/stored")


def _packed(post: DataFrame) -> DataFrame:
    """Postings for an exchange: a text posting's length and positions in one array, which also tells its count; null for the others."""
    return post.select("field", "term", "doc_id", F.concat(F.array("dl"), "positions").alias("packed"))


def _unpacked(post: DataFrame) -> DataFrame:
    n = F.size("packed") - 1
    text = F.col("packed").isNotNull()
    return post.select("field", "term", "doc_id", F.when(text, n).otherwise(F.lit(1)).alias("tf"),
                       F.when(text, F.slice("packed", F.lit(2), n)).alias("positions"), F.get("packed", F.lit(0)).alias("dl"))


def write(tables: IndexTables, path: str, max_records_per_file: int = 5_000_000,
          layout: str = "range", skip_stored: bool = False) -> dict:
    """Write the tables of a version into a fresh folder.

    In the ``range`` layout files cover disjoint ranges of (field, term, doc_id)
    or (field, value, doc_id), so a lookup opens only the files its keys fall in; a
    term in very many documents spans several files. The dictionary is written
    first, and the ranges of the postings follow from it (``layout.file_starts``).
    ``local`` saves that shuffle: sorted inside each file, every file spans all terms. The stored
    table is written first and the caller writes the manifest last, so a
    reader never sees a half-built version as complete.
    """
    w = lambda df: _writer(df, max_records_per_file)
    written = {}
    if not skip_stored:
        _write_stored(tables.stored, path, max_records_per_file)
        written["stored"] = f"{path}/stored"
    spark = tables.stored.sparkSession
    # By document id, whatever order the documents came in: a fetch opens the files of its hits only.
    files = spark.read.parquet(f"{path}/stored").select("doc_id", F.col("_metadata.file_name").alias("file"))
    w(_layout(files, ["doc_id"], layout)).parquet(f"{path}/locations")
    written["locations"] = f"{path}/locations"
    if tables.postings is not None:
        post = tables.postings
        if layout == "range":
            w(_layout(term_dictionary(post), ["field", "term"], layout)).parquet(f"{path}/terms")
            starts = file_layout.file_starts(spark.read.parquet(f"{path}/terms"), post, spark.sparkContext.defaultParallelism)
            w(_unpacked(file_layout.deal(_packed(post), starts))).parquet(f"{path}/postings")
        else:
            w(post.sortWithinPartitions("field", "term", "doc_id")).parquet(f"{path}/postings")
            post = spark.read.parquet(f"{path}/postings")
            w(_layout(term_dictionary(post), ["field", "term"], layout)).parquet(f"{path}/terms")
        written.update(postings=f"{path}/postings", terms=f"{path}/terms")
    if tables.lengths is not None:
        # One narrow pass over the stored texts; documents without any token
        # have no row (they never count).
        w(tables.lengths.where("length > 0")).parquet(f"{path}/lengths")
        lengths = spark.read.parquet(f"{path}/lengths")
        # coalesce after the aggregate's exchange: only the final rows (one
        # per field) are merged; the partial aggregation stays parallel.
        w(field_stats(lengths).coalesce(1)).parquet(f"{path}/field_stats")
        back, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/field_stats")
        if layout == "range":
            # The files are sorted and of disjoint ranges already, and so are the blocks made from each.
            scratch = scratch_path(spark, "block-pieces")
            try:
                pieces = blockmax.piece_blocks(back, stats)
                pieces.write.option("compression", "zstd").parquet(scratch)
                blocks = blockmax.joined_pieces(spark.read.schema(pieces.schema).parquet(scratch))
                w(blocks.sortWithinPartitions("field", "term", "block")).parquet(f"{path}/blocks")
            finally:
                delete_path(spark, scratch)
        else:
            w(_layout(blockmax.block_table(back, stats), ["field", "term", "block"], layout)).parquet(f"{path}/blocks")
        written.update(lengths=f"{path}/lengths", field_stats=f"{path}/field_stats", blocks=f"{path}/blocks")
    for name in ("long_points", "double_points"):
        df = getattr(tables, name)
        if df is not None:
            w(_layout(df, ["field", "value", "doc_id"], layout)).parquet(f"{path}/{name}")
            written[name] = f"{path}/{name}"
    return written


def write_version(docs: DataFrame, fields, path: str, pattern: str = analyzer.DEFAULT_PATTERN,
                  max_records_per_file: int = 5_000_000, layout: str = "range",
                  after_stored=None) -> tuple[dict, int]:
    """B7-B11 in one pass over the input: write ``stored`` first while
    counting its rows (``observe``), then derive postings, lengths and points
    from the written table (column-pruned Parquet reads), so an expensive
    input (NDJSON parse + validation) is evaluated once. Texts are tokenized
    once too: the runs are written to scratch, and dictionary, lengths and
    postings read them from there. Returns the written
    paths and the number of documents written."""
    from pyspark.sql import Observation
    fl = fields_of(fields)
    obs = Observation(f"stored_rows_{uuid.uuid4().hex[:8]}")
    st = stored(docs, fl).observe(obs, F.count(F.lit(1)).alias("n"))
    _write_stored(st, path, max_records_per_file)
    written_docs = int(obs.get["n"])
    if after_stored is not None:
        after_stored()  # may raise to stop before the derived tables
    spark = docs.sparkSession
    back = spark.read.parquet(f"{path}/stored")
    runs = text_runs(spread(back), fl, pattern)
    scratch = None if runs is None else scratch_path(spark, "text-runs")
    try:
        if runs is not None:
            runs.write.option("compression", "zstd").parquet(scratch)
            runs = spark.read.schema(runs.schema).parquet(scratch)
        tables = IndexTables(
            stored=back, postings=postings(back, fl, pattern, runs),
            lengths=None if runs is None else runs.select("field", "doc_id", F.col("dl").alias("length")),
            long_points=points(back, fl, FieldType.LONG), double_points=points(back, fl, FieldType.DOUBLE))
        out = write(tables, path, max_records_per_file, layout, skip_stored=True)
    finally:
        if scratch is not None:
            delete_path(spark, scratch)
    out["stored"] = f"{path}/stored"
    return out, written_docs


def read(spark, path: str) -> IndexTables:
    from lexidx.session import path_exists

    def opt(name):
        p = f"{path}/{name}"
        return spark.read.parquet(p) if path_exists(spark, p) else None  # not every index has every table
    return IndexTables(stored=opt("stored"), postings=opt("postings"), lengths=opt("lengths"),
                       long_points=opt("long_points"), double_points=opt("double_points"),
                       written_terms=opt("terms"), written_stats=opt("field_stats"), blocks=opt("blocks"), locations=opt("locations"), path=path)


# Fixed value: a message that must read as it does.
COUNTS_DIFFER = "Index verification failed: expected %d docs but found %d"


class IndexVerificationError(RuntimeError):
    pass


def verify_counts(expected: int, found: int) -> None:
    """The read-back document count must equal the written one."""
    if expected != found:
        raise IndexVerificationError(COUNTS_DIFFER % (expected, found))


def verify_build(docs: DataFrame, stored_df: DataFrame) -> DataFrame:
    """B10 as a table: one row (expected, found, ok, message).

    Both counts come from one aggregate over the tagged union of the two
    sides, so no join is needed.
    """
    both = docs.select(F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        stored_df.select(F.lit(0).alias("e"), F.lit(1).alias("s")))
    c = both.agg(F.sum("e").cast("bigint").alias("expected"), F.sum("s").cast("bigint").alias("found"))
    c = c.select(F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return c.select(
        "expected", "found", (F.col("expected") == F.col("found")).alias("ok"),
        F.when(F.col("expected") != F.col("found"), F.format_string(COUNTS_DIFFER, F.col("expected"), F.col("found"))).alias("message"))

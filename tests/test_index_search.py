"""Index build and lookups, checked against brute force in plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lexidx.functions import analyzer
from lexidx.operators import index, search
from lexidx.operators.schema import fields_of
from lexidx.plans import tables
from tests.conftest import SF_SMALL

F1 = fields_of([("title", "text"), ("tag", "keyword"), ("count", "long")])


def _docs(spark):
    return spark.createDataFrame(
        [(1, "Amber Lantern", "lamp", 42), (2, "Quiet harbour", "port", 7),
         (3, "amber amber dusk", "lampshade", 3)], "doc_id bigint, title string, tag string, count bigint")


def test_text_and_keyword_lookup(spark):
    t = index.build(_docs(spark), F1)
    assert [r.doc_id for r in search.term_lookup(t.postings, "title", "amber").orderBy("doc_id").collect()] == [1, 3]
    assert [r.doc_id for r in search.term_lookup(t.postings, "tag", "lamp").collect()] == [1]
    hits = search.bm25_topk(t.postings, t.terms(), t.stats(), "title", ["amber"], 10)
    got = search.fetch_stored(hits, t.stored, max_hits=10).orderBy("rank").collect()
    assert got[0].title == "amber amber dusk" and got[1].title == "Amber Lantern"


def test_postings_positions_and_long_tokens(spark):
    long_tok = "x" * 600
    df = spark.createDataFrame([(1, f"a b a {long_tok} b a")], "doc_id bigint, title string")
    p = {r.term: (r.tf, list(r.positions), r.dl) for r in index.text_postings(df, "title").collect()}
    # 600 chars -> chunks of 255, 255 and 90, each its own position
    assert p["a"] == (3, [0, 2, 7], 8) and p["b"] == (2, [1, 6], 8)
    assert p["x" * 255][:2] == (2, [3, 4]) and p["x" * 90] == (1, [5], 8)


def test_only_terms_matches_full_postings(spark):
    d = tables.documents_index_input(spark, SF_SMALL)
    full = index.text_postings(d, "text").where(F.col("term").isin("the", "der"))
    part = index.text_postings(d, "text", only_terms=["the", "der"])
    norm = lambda df: sorted((r.term, r.doc_id, r.tf, tuple(r.positions), r.dl) for r in df.collect())
    assert norm(full) == norm(part)


def test_bm25_matches_brute_force(spark):
    rows = tables.documents_index_input(spark, SF_SMALL).select("doc_id", "text").collect()
    pat = re.compile(r"[^\W]+", re.UNICODE)  # letters, digits, underscore: the portable pattern
    toks = {r.doc_id: pat.findall(r.text.lower()) for r in rows}
    terms = ["the", "was", "und"]
    n = sum(1 for t in toks.values() if t)
    avg = sum(len(t) for t in toks.values()) / n
    df = {q: sum(1 for t in toks.values() if q in t) for q in terms}
    want = {}
    for d, t in toks.items():
        c = Counter(t)
        s = sum(math.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5)) * c[q] / (c[q] + 1.2 * (0.25 + 0.75 * len(t) / avg))
                for q in terms if c[q])
        if s:
            want[d] = s
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]
    d = tables.documents_index_input(spark, SF_SMALL)
    t = index.build(d, tables.DOCUMENT_FIELDS, pattern=analyzer.PORTABLE_PATTERN)
    got = search.bm25_topk(t.postings, t.terms(), t.stats(), "text", terms, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [b[0] for b in best]
    assert all(abs(r.score - b[1]) < 1e-9 for r, b in zip(got, best))


def test_points_range_and_sort(spark):
    t = index.build(_docs(spark), F1)
    got = search.numeric_range(t.long_points, "count", 5, 50).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 2]
    s = search.sort_by_field(t.stored, "count", descending=True).collect()
    assert [r.doc_id for r in s] == [1, 2, 3]


def test_write_read_verify(spark, tmp_dir):
    t = index.build(_docs(spark), F1)
    written = index.write(t, f"{tmp_dir}/v1")
    assert {"stored", "postings", "terms", "lengths", "field_stats", "long_points"} <= set(written)
    back = index.read(spark, f"{tmp_dir}/v1")
    assert back.stored.count() == 3
    v = index.verify_build(_docs(spark), back.stored).collect()[0]
    assert v.ok and v.message is None
    bad = index.verify_build(_docs(spark), back.stored.limit(2)).collect()[0]
    assert bad.message == "Index verification failed: expected 3 docs but found 2"


def test_range_layout_same_content(spark, tmp_dir):
    t = index.build(_docs(spark), F1)
    index.write(t, f"{tmp_dir}/a", layout="local")
    index.write(t, f"{tmp_dir}/b", layout="range")
    rows = lambda p: sorted(tuple(r) for r in spark.read.parquet(p).select("field", "term", "doc_id", "tf").collect())
    assert rows(f"{tmp_dir}/a/postings") == rows(f"{tmp_dir}/b/postings")


def test_tokenizer_word_breaks(spark):
    df = spark.createDataFrame([("中文 Text ひらがな カタカナ don't 3.14 U.S.A e-mail a中b",)], "t string")
    got = df.select(analyzer.tokens(F.col("t")).alias("x")).collect()[0].x
    assert got == ["中", "文", "text", "ひ", "ら", "が", "な", "カタカナ", "don't", "3.14", "u.s.a",
                   "e", "mail", "a", "中", "b"]


def test_query_terms_use_the_document_analyser(spark):
    assert search.query_terms(spark, "Hello, World! don't") == ["hello", "world", "don't"]


def test_unindexed_bm25_equals_indexed(spark):
    d = tables.documents_index_input(spark, SF_SMALL)
    terms = ["the", "was", "the", "und"]
    t = index.build(d, tables.DOCUMENT_FIELDS)
    a = search.bm25_topk(t.postings, t.terms(), t.stats(), "text", terms, 10).orderBy("rank").collect()
    b = search.bm25_topk_unindexed(d, "text", terms, 10).orderBy("rank").collect()
    assert [r.doc_id for r in a] == [r.doc_id for r in b]
    assert all(abs(x.score - y.score) < 1e-9 for x, y in zip(a, b))


def test_bm25_on_published_version_equals_unindexed(spark, tmp_dir):
    d = tables.documents_index_input(spark, SF_SMALL)
    index.write_version(d, tables.DOCUMENT_FIELDS, tmp_dir)
    a = search.bm25_topk_version(index.read(spark, tmp_dir), "text", ["that", "was"], 10).orderBy("rank").collect()
    b = search.bm25_topk_unindexed(d, "text", ["that", "was"], 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in a] == [(r.doc_id, round(r.score, 9)) for r in b]


def test_sort_by_field_nulls_last_and_ties_by_doc(spark):
    st = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 9)], "doc_id bigint, count bigint")
    asc = [r.doc_id for r in search.sort_by_field(st, "count").collect()]
    desc = [r.doc_id for r in search.sort_by_field(st, "count", descending=True).collect()]
    assert asc == [1, 3, 4, 2] and desc == [4, 1, 3, 2]


def test_fetch_opens_only_the_files_that_hold_the_hits(spark, tmp_dir):
    """Documents stored in random order over 20 files: no range of ids helps, the table of locations does."""
    import random
    ids = list(range(2000))
    random.Random(3).shuffle(ids)
    docs = spark.createDataFrame([(d, f"text {d}", "t", d) for d in ids], "doc_id bigint, title string, tag string, count bigint").coalesce(1)
    index.write_version(docs, F1, tmp_dir, max_records_per_file=100)
    t = index.read(spark, tmp_dir)
    assert len(t.stored.inputFiles()) == 20 and t.locations.count() == 2000
    hits = spark.createDataFrame([(1, 17), (2, 1203), (3, 1999), (4, 5000)], "rank int, doc_id bigint")
    got = search.fetch_version(t, hits, 10)
    assert {(r.rank, r.doc_id, r.title) for r in got.collect()} == {(1, 17, "text 17"), (2, 1203, "text 1203"), (3, 1999, "text 1999")}
    holding = {r.f for r in t.stored.where("doc_id in (17, 1203, 1999)").select(F.input_file_name().alias("f")).collect()}
    assert set(got.inputFiles()) == holding and len(holding) <= 3
    assert search.fetch_version(t, hits.where("rank = 4"), 10).count() == 0

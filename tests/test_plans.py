"""The physical plans keep the properties the design relies on at scale."""

from lexidx.operators import index, search
from lexidx.plans import tables
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "100000")  # show pushed filters in full
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")


def test_postings_build_has_no_shuffle(spark):
    d = tables.documents_index_input(spark, SF_SMALL)
    assert "Exchange" not in _plan(index.text_postings(d, "text"))


def test_term_lookup_pushes_filters_and_prunes(spark, tmp_dir):
    d = tables.documents_index_input(spark, SF_SMALL)
    index.write_version(d, tables.DOCUMENT_FIELDS, tmp_dir)
    post = index.read(spark, tmp_dir).postings
    p = _plan(search.term_lookup(post, "text", "was"))
    assert "EqualTo(field,text)" in p and "EqualTo(term,was)" in p
    assert "positions" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_bm25_broadcasts_only_query_sized_sides(spark, tmp_dir):
    d = tables.documents_index_input(spark, SF_SMALL)
    index.write_version(d, tables.DOCUMENT_FIELDS, tmp_dir)
    t = index.read(spark, tmp_dir)
    terms, stats = spark.read.parquet(f"{tmp_dir}/terms"), spark.read.parquet(f"{tmp_dir}/field_stats")
    p = _plan(search.bm25_topk(t.postings, terms, stats, "text", ["was", "the"], 10))
    assert "TakeOrderedAndProject" in p and "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p and "NestedLoop" not in p and "Cartesian" not in p
    assert "partial_sum" in p  # map-side combine before the doc_id shuffle


def test_fetch_stored_pushes_ranges_for_few_and_many_hits(spark, tmp_dir):
    d = tables.documents_index_input(spark, SF_SMALL)
    index.write_version(d, tables.DOCUMENT_FIELDS, tmp_dir)
    t = index.read(spark, tmp_dir)
    for hits in (search.bm25_topk_version(t, "text", ["was"], 5), spark.range(0, 1000, 2).withColumnRenamed("id", "doc_id")):
        got = search.fetch_stored(hits, t.stored, max_hits=500)
        scan = _plan(got).split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(doc_id," in scan and "LessThanOrEqual(doc_id," in scan
        want = {r.doc_id for r in hits.collect()} & {r.doc_id for r in d.select("doc_id").collect()}
        assert {r.doc_id for r in got.collect()} == want


def test_id_ranges_cover_the_ids_and_cut_at_the_widest_gaps():
    assert search.id_ranges([1, 2, 3, 50, 51, 900], 3) == [(1, 3), (50, 51), (900, 900)]
    assert search.id_ranges([5], 3) == [(5, 5)] and len(search.id_ranges(list(range(0, 1000, 2)), 32)) == 32


def test_unindexed_scoring_shuffles_only_the_top(spark):
    d = tables.documents_index_input(spark, SF_SMALL)
    p = _plan(search.bm25_topk_unindexed(d, "text", ["was", "the"], 10))
    assert "TakeOrderedAndProject" in p and "Generate" not in p and "hashpartitioning" not in p


def test_range_lookup_pushes_value_bounds(spark, tmp_dir):
    d = tables.part_index_input(spark, SF_SMALL)
    index.write_version(d, tables.PART_FIELDS, tmp_dir)
    p = _plan(search.numeric_range(index.read(spark, tmp_dir).long_points, "count", 10, 20))
    assert "GreaterThanOrEqual(value,10)" in p and "LessThanOrEqual(value,20)" in p

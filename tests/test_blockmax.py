"""Block maxima: same hits as scoring every posting, with fewer postings read."""

import random

import pytest
from pyspark.sql import functions as F

from lexidx.operators import blockmax, index, search
from lexidx.operators.schema import fields_of

FIELDS = fields_of([("body", "text"), ("tag", "keyword")])
N = 6000


@pytest.fixture(scope="module")
def version(spark, tmp_path_factory):
    """Documents in which `often` is everywhere, `seldom` in a few neighbours, `twin` in equal texts."""
    rng = random.Random(8)
    filler = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(N):
        words = ["often"] * rng.randint(1, 4) + rng.choices(filler, k=rng.randint(3, 20))
        if 3000 <= d < 3020:
            words += ["seldom"] * (1 + d % 3)
        if d % 500 == 7:
            words = ["twin", "often", "w1"]
        rng.shuffle(words)
        rows.append((d - 300, " ".join(words), "t"))  # ids below zero too
    docs = spark.createDataFrame(rows, "doc_id long, body string, tag string").repartition(4, "doc_id")
    path = str(tmp_path_factory.mktemp("blockmax"))
    index.write_version(docs, FIELDS, path)
    return index.read(spark, path)


def everything(t, terms, k, field="body"):
    return [(r.rank, r.doc_id, round(r.score, 9)) for r in
            search.bm25_topk(t.postings, t.terms(), t.stats(), field, terms, k).orderBy("rank").collect()]


def pruned(t, terms, k, field="body"):
    return [(r.rank, r.doc_id, round(r.score, 9)) for r in search.bm25_topk_version(t, field, terms, k).orderBy("rank").collect()]


@pytest.mark.parametrize("terms,k", [(["often", "seldom"], 10), (["often"], 10), (["twin", "often"], 7), (["seldom", "seldom", "w3"], 25),
                                     (["w1", "w2", "w3"], 1), (["twin"], 100), (["nowhere"], 5), (["often", "nowhere"], 3)])
def test_same_hits_as_scoring_all(version, terms, k):
    assert pruned(version, terms, k) == everything(version, terms, k)


def test_ties_at_the_threshold_go_to_smaller_ids(version):
    hits = pruned(version, ["twin"], 5)
    assert len({s for *_, s in hits}) == 1 and [d for _, d, _ in hits] == [-293, 207, 707, 1207, 1707]


def test_rare_term_reads_a_fraction_of_the_blocks(version):
    _, found = search.bm25_selection(version, "body", ["often", "seldom"], 10)
    read = found.postings.count()
    assert found.of_blocks == -(-N // blockmax.BLOCK) + 1 and found.blocks <= 2
    assert read == found.expected_postings < found.of_postings / 8
    # the same filter without the block numbers: whole ranges, a superset
    scores, _ = search.bm25_selection(version, "body", ["often", "seldom"], 10)
    assert search.top_k(scores(found.postings), 10).count() == 10


def test_more_blocks_than_are_listed(version, monkeypatch):
    monkeypatch.setattr(blockmax, "LISTED_BLOCKS", 0)
    for terms, k in ((["often", "seldom"], 10), (["often"], 30)):
        assert pruned(version, terms, k) == everything(version, terms, k)


def test_fields_without_lengths_and_versions_without_blocks(version):
    assert pruned(version, ["t"], 3, field="tag") == []
    t = index.IndexTables(version.stored, version.postings, version.lengths, None, None, version.written_terms, version.written_stats)
    assert pruned(t, ["often", "seldom"], 10) == everything(version, ["often", "seldom"], 10)


def test_bounds_hold_for_every_posting(version):
    st = search._term_weights(version.postings.sparkSession, version.terms(), version.stats(), "body", ["often", "w5"])
    per = search._scored(version.postings, st, "body", ["often"]).withColumn("block", blockmax.block_of(F.col("doc_id")))
    weight = {r.term: r.idf * r.qcount for r in st.collect()}["often"]
    top = {r.block: r.s for r in per.groupBy("block").agg(F.max("score").alias("s")).collect()}
    kept = {r.block: r.impact * weight for r in version.blocks.where("field = 'body' and term = 'often'").collect()}
    assert top.keys() == kept.keys() and all(abs(top[b] - kept[b]) < 1e-9 for b in top)


def test_ranges_cover_blocks():
    blocks = [1, 2, 3, 90, 91, 500, *range(1000, 1400, 3)]
    ranges = blockmax.merged(blocks)
    assert len(ranges) <= blockmax.RANGES and all(any(a <= b <= z for a, z in ranges) for b in blocks)

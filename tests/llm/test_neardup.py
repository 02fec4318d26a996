"""Components equal those of an all-pairs comparison of full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidx.llm import neardup, queries
from tests.llm.helpers import SF_SMALL, clashing, docs


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    m = min(n, len(words))
    return frozenset(tuple(words[i:i + m]) for i in range(len(words) - m + 1))


def brute(rows, n, num, den):
    """{id: (set size, component)}; rows of one id are one document."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, q in sets[:a]:
            if s and q and den * len(s & q) >= num * len(s | q):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_whole_table_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows, 3, 85, 100)
    got = queries.op4_neardup(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_hot_passages_and_edge_rows(spark):
    """Chains of near copies around the bound, one shared passage everywhere, groups of equal texts, empty and short texts."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = []
    base = [rnd.choice(vocabulary) for _ in range(80)]
    for _ in range(60):  # each a few edits from the one before
        base = list(base)
        for _ in range(rnd.randint(1, 4)):
            base[rnd.randrange(80)] = rnd.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40))) for _ in range(120)]
    texts += ["Same Text\there now"] * 5 + ["same text here NOW", "one two", "one two", "ONE two", "one", "", "  \n", None, None]
    rnd.shuffle(texts)
    want = brute(list(enumerate(texts)), 3, 85, 100)
    got = neardup.near_copies(clashing(docs(spark, texts)), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_repeated_ids_null_ids_and_empty_tables(spark):
    rows = docs(spark, ["a b c d e f", "x y z"], [(0, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    got = neardup.near_copies(rows, 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(0, 0, True), (0, 0, True), (1, 1, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True), (None, True)]
    assert neardup.near_copies(rows.limit(0), 3, 85, 100).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(149, 200), (7, 7)]
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.cid: r.component for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 100}


def test_components_cut_short_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        neardup.components(links, rounds=2)


def test_least_collisions_bounds_the_chance_of_a_miss():
    rng = np.random.default_rng(0)
    for similarity in (0.8, 0.85):
        t = neardup.least_collisions(64, similarity)
        assert (rng.binomial(64, similarity, 2_000_000) < t).mean() < 1e-5 and t > 32


def test_sets_do_not_depend_on_slices():
    mult, add = neardup._mix(neardup.COORDINATES)
    s = neardup.Shingler(3)(" ".join(f"w{i}" for i in range(5000)).encode())
    parts = np.minimum(neardup.signature(s[:1700], mult, add), neardup.signature(s[1700:], mult, add))
    assert (neardup.signature(s, mult, add) == parts).all()


def test_ids_that_repeat_with_other_texts(spark):
    """Rows of one id are one document: its texts are linked, and a document stays once."""
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(40)) for _ in range(n))
    a, b, c, d, e = (say(30) for _ in range(5))
    rows = [(1, a), (5, a), (5, b), (5, ""), (9, b + " end"), (12, c), (12, c), (12, c), (12, None), (20, d), (20, e), (30, e), (31, None), (31, None)]
    rows += [(40, say(20)) for _ in range(30)] + [(7, say(20)) for _ in range(5)]
    rows.append((41, rows[17][1]))
    rnd.shuffle(rows)
    table = docs(spark, [], [*rows, (None, a), (None, a)])
    want = sorted((i, component) for i, (_, component) in brute(rows, 3, 85, 100).items())
    got = neardup.near_copies(table, 3, 85, 100).where("doc_id is not null").collect()
    assert len(got) == len(rows) and sorted({(r.doc_id, r.component_id) for r in got}) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = neardup.drop_near_copies(table, 3, 85, 100)
    assert left.columns == table.columns
    stay = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(i for i, _ in stay if i is not None) == sorted(i for i, component in want if i == component)
    assert set(stay) <= {*rows, (None, a)} and dict(stay)[12] == c and stay.count((None, a)) == 2


def test_sets_of_repeated_rows_come_once(spark):
    rows = docs(spark, [], [(3, "a b c d e f")] * 500 + [(3, "u v w x y z")] * 2)
    sigs = neardup.signatures(rows, 3, "doc_id", "text")
    named = sigs.selectExpr("doc_id as first_id", "fp1", "fp2").distinct().withColumn("cid", F.xxhash64("fp1"))
    assert neardup.class_sets(rows, named, 3, "doc_id", "text").count() == 2

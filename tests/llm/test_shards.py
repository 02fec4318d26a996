"""Counts at most one apart, slots gapless, equal texts together as far as the law allows."""

import zlib
from collections import Counter, defaultdict

from lexidx.llm import queries, shards
from tests.llm.helpers import SF_SMALL, clashing, docs


def check(rows, texts, n=8):
    """The law holds and sizes and digests are those of the rows."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(n)) and max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(n))) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(queries.op10_shards(spark, SF_SMALL).collect(), texts)


def test_groups_stay_together_and_a_hot_text_is_split(spark):
    texts = [f"group {i // 4}" for i in range(200)] + [f"single {i}" for i in range(600)]
    rows = shards.shard_documents(clashing(docs(spark, texts))).collect()
    check(rows, list(enumerate(texts)))
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    whole = sum(len(where[f"group {g}"]) == 1 for g in range(50))
    assert whole >= 45
    texts = ["hot"] * 300 + [None, "", ""] + [f"single {i}" for i in range(400)]
    rows = shards.shard_documents(docs(spark, texts)).collect()
    check(rows, list(enumerate(texts)))
    assert Counter(r.shard for r in rows if r.doc_id < 300).most_common(1)[0][1] >= 80  # a whole shard's worth stays together


def test_repeated_null_and_no_rows(spark):
    rows = docs(spark, ["a", None], [(0, "a"), (None, "a"), (None, None)])
    out = shards.shard_documents(rows).collect()
    assert len(out) == 5 and {r.size for r in out} == {1, 2}
    assert max(Counter(r.shard for r in out).values()) == 1
    assert shards.shard_documents(rows.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = queries.op10_shards(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

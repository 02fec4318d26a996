"""Each stage against its operator and brute force; the whole run against the stages."""

import corpus_pipeline
from lexidx.llm import decontaminate, pii, sentencepiece
from lexidx.llm.common import staged, table
from tests.llm.helpers import SF_SMALL, clashing, docs
from tests.llm.test_neardup import brute


def test_stages_and_run_over_the_whole_table(spark):
    rows = table(spark, SF_SMALL, "documents")
    columns, results = rows.columns, {}
    now = rows
    for name, stage in corpus_pipeline.STAGES:
        now = staged(spark, stage(spark, now, SF_SMALL), f"test-{name}")
        results[name] = now
        assert name == "encoding" or now.columns == columns
    texts = {n: {r.doc_id: r.text for r in results[n].collect()} for n in list(results)[:-1]}
    before = {r.doc_id: r.text for r in rows.collect()}
    good = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect() if r.quality is not None}
    kept = [texts["quality"].keys() >= {i} for i, y in good.items() if y == 1]
    gone = [i not in texts["quality"] for i, y in good.items() if y == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.9 * len(gone)
    assert all(before[i] == t for i, t in texts["quality"].items())
    groups = brute(list(texts["quality"].items()), 5, 80, 100)
    assert set(texts["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    found = {r.doc_id for r in decontaminate.leaks(results["near_duplicates"], table(spark, SF_SMALL, "benchmark")).collect()}
    assert set(texts["decontamination"]) == set(texts["near_duplicates"]) - found
    assert texts["personal_data"] == {i: pii.redacted_text(t) for i, t in texts["decontamination"].items()}
    assert not any(pii.find_spans(t)["email"] for t in texts["personal_data"].values())
    back = {r.doc_id: r.text for r in sentencepiece.decode(results["encoding"]).collect()}
    assert back == texts["personal_data"]
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert whole == {r.doc_id: list(r.ids) for r in results["encoding"].collect()}


def test_stages_bear_awkward_rows(spark):
    """Nulls, empty texts, repeated rows and further columns pass every filtering stage; empty tables stay empty."""
    rows = docs(spark, ["plain words " * 5, None, "", "plain words " * 5, "other words " * 4], [(None, "no id at all"), (None, None)])
    for table_in in (rows, clashing(rows)):
        now = table_in
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            now = stage(spark, now, SF_SMALL)
            assert now.columns == table_in.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect()) == [
            (False, 0), (False, 1), (False, 2), (False, 4), (True, 0), (True, 0)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF_SMALL).count() == 0

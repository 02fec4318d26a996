"""The driver contract of __spark_entry__."""

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["rank", "doc_id", "score"]


def test_oracles_cover_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    base = set(q) - set(entry_mod.LLM_QUERIES)
    assert base <= set(o) and len(base) == 65  # every query of the library's own operators has its SQL

"""The registered queries of the subpackage: opN_<name> and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from lexidx.llm import ann, chat, decontaminate, neardup, pii, quality, runs, sentencepiece, shards, spelling, sql, substrings, toxicity, warc
from lexidx.llm.common import table


def op1_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_neardup(spark, sf_dir):
    return neardup.near_copies(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op5_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(table(spark, sf_dir, "documents"), check=True)


def op8_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{TRIAL}'), (-7L, 1L, 'assistant', '{TRIAL}') AS t(conv_id, turn, role, text)")
    return chat.digest(chat.format_conversations(rows.unionByName(trial)))


def op10_shards(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op11_substrings(spark, sf_dir):
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op12_runs(spark, sf_dir):
    return runs.digest(runs.find_runs(table(spark, sf_dir, "documents"), loops=True))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(spark, table(spark, sf_dir, "documents"), typos=97)


TRIAL = sql.TRIAL

QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_pii, op4_neardup, op5_decontamination, op6_warc,
                                       op7_sentencepiece, op8_ann, op9_chat, op10_shards, op11_substrings,
                                   op12_runs, op13_spelling)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL = dict(sql.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

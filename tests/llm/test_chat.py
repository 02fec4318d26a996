"""Formatting, read back, equals the rows it came from."""

import hashlib
import time

from pyspark.sql import functions as F

from lexidx.llm import chat, queries
from tests.llm.helpers import SF_SMALL

KIND = "conv_id long, turn long, role string, text string"


def digest_of(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_reads_back_every_conversation(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    want[-7] = [("user", queries.TRIAL), ("assistant", queries.TRIAL)]
    assert read(queries.op9_chat(spark, SF_SMALL)) == {k: digest_of(v) for k, v in want.items()}


def test_layout_escapes_merging_and_edge_rows(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "[AND][ROLE]x[/ROLE]", "<", "[", "<s", "\\", "𝒳é\n", "", None, "|</s"]
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "yo"), (1, 2, "assistant", "yo"),
            (2, None, None, "x"), (2, 0, "[/ROLE]", "y"), (None, 0, "user", "lost")]
    rows += [(3, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(nasty * 2)]
    df = spark.createDataFrame(rows, KIND).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    out = chat.format_conversations(df)
    by = {r.conv_id: r for r in out.collect()}
    assert by[1].formatted == "<s>[ROLE]user[/ROLE]hi[AND]</s><s>[ROLE]assistant[/ROLE]yo[AND]yo</s>"
    assert [(s.start, s.length) for s in by[1].loss_spans] == [(56, 2), (63, 2)]
    want = {1: [("user", "hi"), ("user", None), ("assistant", "yo"), ("assistant", "yo")],
            2: [(None, "x"), ("[/ROLE]", "y")], None: [("user", "lost")],
            3: [("assistant" if i % 3 else "user", t) for i, t in enumerate(nasty * 2)]}
    assert read(chat.digest(out)) == {k: digest_of(v) for k, v in want.items()}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = queries.op9_chat(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_long_conversations_stay_linear(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("é </s> "), F.col("id").cast("string")).alias("text"))
    turns = [("user" if i % 3 == 0 else "assistant", f"é </s> {i}") for i in range(n)]
    began = time.time()
    assert read(chat.digest(chat.format_conversations(rows))) == {1: digest_of(turns)}
    assert time.time() - began < 60


def test_chunk_bounds(spark):
    """Conversations of about one, two and three chunks of pieces and of spans."""
    sizes = [c * chat.CHUNK + d for c in (1, 2) for d in (-1, 0, 1)] + [1, 2]
    turns = {k: [("assistant" if (i + k) % 2 else "user", "x" * (i % 4)) for i in range(n)] for k, n in enumerate(sizes)}
    turns[100] = [("assistant", "") for _ in range(chat.CHUNK + 1)]
    turns[101] = [("user", "u") for _ in range(chat.CHUNK + 1)]
    df = spark.createDataFrame([(k, i, r, t) for k, v in turns.items() for i, (r, t) in enumerate(v)], KIND)
    assert read(chat.digest(chat.format_conversations(df))) == {k: digest_of(v) for k, v in turns.items()}

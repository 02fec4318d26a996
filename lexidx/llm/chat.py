"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn (ties by
role, then text); adjacent turns of one role are merged into a block by array
functions, and everything is concatenated into one string::

    <s>[ROLE]user[/ROLE]first text[AND]second text</s><s>[ROLE]assistant[/ROLE]...</s>

Control strings inside texts and role names get a backslash after their first
character (one more where backslashes stand there already), which
``unescape`` takes away again; all other text stays as it is. The loss mask is
an array of (start, length) in code points over the output, one entry for each
assistant text, empty ones included.

Defined cases: a null text or role counts as empty, a null turn sorts first,
rows with a null conversation id form one conversation; repeated rows are
turns of their own; an empty table gives no rows; other columns are ignored.
A conversation is one output row, so its turns meet in one task by definition; very long ones take
time in proportion to their length, but for one look per chunk at what comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings. [INST] and [/INST] are reserved, so they are escaped too.
BEGIN, END, ROLE, ROLE_END, AND = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[AND]"
CHUNK = 512  # pieces or spans worked on at a time
CONTROL_TAIL = r"(/?s>|/?ROLE\]|/?INST\]|AND\])"
_ESCAPABLE = r"([<\[])(\\*)(?=" + CONTROL_TAIL + ")"
_ESCAPED = r"([<\[])\\(\\*)(?=" + CONTROL_TAIL + ")"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPABLE, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation."""
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                      F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = (src.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    # A block starts wherever the role differs from the turn before.
    starts = turns.withColumn("starts", F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])))
    blocks = starts.select("conv_id", F.transform("starts", lambda start, k: F.struct(
        F.element_at("turns", start)["role"].alias("role"),
        F.transform(F.slice("turns", start, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - start),
                    lambda t: escape(t["text"])).alias("texts"))).alias("blocks"))
    headed = blocks.select("conv_id", F.transform("blocks", lambda b: F.struct(
        b["role"].alias("role"), b["texts"].alias("texts"),
        F.concat(F.lit(BEGIN + ROLE), escape(b["role"]), F.lit(ROLE_END)).alias("head"))).alias("blocks"))
    # Pieces in order, each with the code points it takes; the mask needs their running sums.
    pieces = headed.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], AND), F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: F.struct(
            (F.when(k == 0, F.length(b["head"])).otherwise(len(AND))).alias("lead"),
            F.length(t).alias("chars"),
            F.when(k == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("tail"),
            (b["role"] == "assistant").alias("loss"))))).alias("pieces"))
    def size(p):
        return p["lead"] + p["chars"] + p["tail"]

    def spans_of(chunk, before):
        return F.aggregate(
            chunk, F.struct(before.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + size(p)).alias("at"),
                F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start"), p["chars"].alias("length")))))
                .otherwise(acc["spans"]).alias("spans")),
            lambda acc: acc["spans"])

    # Growing an array copies it, so pieces are summed in chunks, and each chunk starts from the chunks before it.
    cut = pieces.select("conv_id", "formatted", _chunks("pieces").alias("chunks"))
    before = F.aggregate(F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + size(p))), F.array(F.lit(0)),
                         lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    spans = F.zip_with("chunks", F.slice(before, 1, F.size("chunks")), spans_of)
    return cut.select("conv_id", "formatted", F.flatten(spans).alias("loss_spans"))


def _chunks(array: str) -> Column:
    """The array in pieces of CHUNK entries."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda c: F.slice(array, c * CHUNK + 1, CHUNK))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` and ``loss_text``, read back from the string and the mask alone.

    ``turns`` is an array of (role, text) with the texts as they were before formatting.
    """
    block = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    turns = F.flatten(F.transform(block, lambda b: F.transform(
        F.split(F.substring_index(b, ROLE_END, -1), r"\[AND\]", -1),
        lambda t: F.struct(
            unescape(F.substring_index(F.substring_index(b, ROLE_END, 1), BEGIN + ROLE, -1)).alias("role"),
            unescape(t).alias("text")))))
    # Code points are counted from the start of a string, so spans are cut from the stretch of their chunk.
    def stretch(chunk):
        first, last = chunk[0], F.element_at(chunk, -1)
        return F.struct(chunk.alias("spans"), F.substring(F.col("formatted"), first["start"] + 1, last["start"] + last["length"] - first["start"]).alias("text"))

    stretches = F.when(F.size("loss_spans") > 0, F.transform(_chunks("loss_spans"), stretch)).otherwise(F.array())
    loss = F.array_join(F.transform(stretches, lambda x: F.array_join(F.transform(
        x["spans"], lambda s: unescape(F.substring(x["text"], s["start"] - x["spans"][0]["start"] + 1, s["length"]))), "")), "")
    return formatted.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), loss.alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a formatted table says when read back, one row per conversation."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_conversations(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

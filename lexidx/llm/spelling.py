"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted over all texts (partial sums before the shuffle).
2. The gram dictionary: a gram of two characters that stands in many words is replaced
   by its extensions by one character, and so on up to ``LONGEST``. Only the frequent
   grams, the inner nodes of that tree, need to be known; the limit above which a
   gram is frequent rises with the number of gram positions, so there are never more than
   ``MOST_FREQUENT`` of them, and they are all that is broadcast.
3. A word, between a start and an end mark, is decomposed into the one gram of the tree
   that begins at each of its positions. No gram is the beginning of another, so an edit
   changes only grams that contain it. The largest number of grams over one position bounds
   the affected grams; all others are found in the other word too, at the same place or next to it.
4. So it is enough to merge the lists of a word's (bound + 1) rarest grams (by a common
   order from a fixed-size count sketch; any common order gives right results): of
   two words one edit apart, both hold the rarest unaffected gram among these. Lists are kept
   by gram, position and word length, so a list holds only words that can match. Words
   of ``LONGEST`` code points or more always have an unaffected gram; shorter ones are refused.
5. Pairs are verified with the edit distance. Every word points to its most frequent near
   word if that is twice as frequent; roots are found by doubling the pointers.

Defined cases: null texts have no words; texts are read whole; a null id changes no word
(its rows count like others); rows that repeat an id all count; ties go to the smaller word
in code-point order; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.llm.common import discard, sliced, staged

SHORTEST = 2            # code points of a gram
LONGEST = 5
FREQUENT = 64           # words a gram stands in before it is extended, at least
MOST_FREQUENT = 200_000
SKETCH = 1 << 16
LEAST_LENGTH = 5        # code points of a word
LEAST_COUNT = 3
START, END = "\x02", "\x03"
LETTERS = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int = 0) -> DataFrame:
    """(word, n): the words of all texts, with A-Z in lower case.

    With ``typos``, a word whose crc32 with its document's id is divisible by that number loses the code point the crc32 points at.
    """
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), 1)).alias("run"))
    words = src.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if typos:
        words = (words.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
                 .withColumn("at", (F.col("h") % F.length("word")).cast("int"))
                 .select(F.when(F.col("id").isNotNull() & (F.col("h") % typos == 0),
                                F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
                         .otherwise(F.col("word")).alias("word")))
    return (words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def grams_of(word: str, frequent) -> list[str]:
    """The gram of the dictionary that begins at each position of the marked word but the last."""
    s = START + word + END
    out = []
    for p in range(len(s) - 1):
        end, last = p + SHORTEST, min(len(s), p + LONGEST)
        while end < last and s[p:end] in frequent:
            end += 1
        out.append(s[p:end])
    return out


def affected(grams: list[str], length: int) -> int:
    """The most grams that one edit of a word of ``length`` can change: the most that stand over one of its positions."""
    over = [0] * (length + 3)
    for p, g in enumerate(grams):
        over[p] += 1
        over[p + len(g)] -= 1
    most = now = 0
    for i, step in enumerate(over[:length + 1]):
        now += step
        if i:
            most = max(most, now)
    return most


def slot_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SKETCH


def frequent_grams(words: DataFrame) -> list[str]:
    """The grams that are extended: in more words than the limit, shorter than LONGEST, not at the end of a word."""
    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(FREQUENT, -(-positions * (LONGEST - SHORTEST) // MOST_FREQUENT))
    marked = words.select(F.concat(F.lit(START), "word").alias("s"))
    grams = marked.select(F.explode(F.flatten(F.transform(
        F.array(*[F.lit(q) for q in range(SHORTEST, LONGEST)]),
        lambda q: F.when(F.length("s") >= q, F.transform(F.sequence(F.lit(1), F.length("s") - q + 1), lambda p: F.substring("s", p, q)))
        .otherwise(F.array().cast("array<string>"))))).alias("gram"))
    return [r[0] for r in grams.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("gram").toLocalIterator()]


def _rarity(words: DataFrame, frequent) -> np.ndarray:
    """SKETCH counters over the grams of all words."""
    def count(batches):
        known, sums = frozenset(frequent.value.split("\n")), np.zeros(SKETCH, np.int64)
        for batch in sliced(batches):
            for word in batch.column(0).to_pylist():
                for g in grams_of(word, known):
                    sums[slot_of(g)] += 1
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums[slots])], ["slot", "c"])

    out = np.zeros(SKETCH, np.int64)
    for r in words.select("word").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).collect():
        out[r[0]] = r[1]
    return out


def _posts(words: DataFrame, frequent, rarity) -> DataFrame:
    """(word, n, gram, position, length): the affected-gram bound + 1 rarest grams of each word."""
    def post(batches):
        known, rare = frozenset(frequent.value.split("\n")), np.frombuffer(rarity.value, np.int64)
        for batch in sliced(batches):
            rows = ([], [], [], [], [])
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = grams_of(word, known)
                by = sorted(range(len(grams)), key=lambda p: (rare[slot_of(grams[p])], grams[p], p))
                for p in by[:affected(grams, len(word)) + 1]:
                    for column, value in zip(rows, (word, n, grams[p], p, len(word))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()),
                                              pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32())],
                                             ["word", "n", "gram", "position", "length"])
    return words.select("word", "n").mapInArrow(post, "word string, n long, gram string, position int, length int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart, both ways round."""
    if words.where(F.length("word") < LONGEST).limit(1).count():
        raise ValueError(f"words need {LONGEST} code points at least")
    sc = words.sparkSession.sparkContext
    frequent = sc.broadcast("\n".join(frequent_grams(words)))
    rarity = sc.broadcast(_rarity(words, frequent).tobytes())
    posts = _posts(words, frequent, rarity)
    probes = posts.select(F.col("word").alias("a"), F.col("n").alias("an"), "gram", F.explode(F.array(
        F.struct("position", "length"),
        F.struct("position", (F.col("length") + 1).alias("length")),
        F.struct((F.col("position") + 1).alias("position"), (F.col("length") + 1).alias("length")))).alias("place"),
        F.col("length").alias("own"))
    probes = probes.select("a", "an", "own", "gram", "place.position", "place.length")
    lists = posts.select(F.col("word").alias("b"), F.col("n").alias("bn"), "gram", "position", "length")
    pairs = (probes.join(lists, ["gram", "position", "length"])
             .where(((F.col("own") < F.col("length")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
             .select("a", "an", "b", "bn").distinct())
    return (pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")),
                                           F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n"))))
                         .alias("p")).select("p.*"))


def group_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n)."""
    written = []
    words = staged(spark, words, "spelling-words", written)
    best = (near_words(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"), F.first("n").alias("own"))
            .select("word", "n_near", F.when(-F.col("best.minus") >= 2 * F.col("own"), F.struct(F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n")))
                    .alias("best")))
    forms = staged(spark, words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), F.col("best.form_n").alias("form_n")), "spelling-forms", written)
    # a form is twice as frequent as its word, so chains are short and end
    up = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        up = staged(spark, up, "spelling-roots", written)
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        if not up.join(higher, "root", "left_semi").limit(1).count():
            break
        up = up.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root"))
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int = 0) -> DataFrame:
    """Words of ``docs`` with their near words, forms and roots."""
    return group_words(spark, count_words(docs, id_col, text_col, typos))

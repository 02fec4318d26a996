import random
import re
import zlib
from collections import Counter

import pytest
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs

from lexidx.llm import spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, typos):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if typos and doc_id is not None and h % typos == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain_groups(count):
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs_on_texts(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    count = plain_counts([(r.doc_id, r.text) for r in df.collect()], 97)
    assert rows_of(spelling.spelling_variants(spark, df, typos=97)) == plain_groups(count)


def test_against_all_pairs_on_crowded_words(spark):
    """Few letters, so grams are frequent and extended, lists overlap and chains of forms arise."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 6, 9, 20, 50]) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert len(spelling.frequent_grams(df)) > 10
    expected = plain_groups(words)
    assert any(form != root and form for _, form, root, *_ in expected)
    assert rows_of(spelling.group_words(spark, df)) == expected


def test_bound_of_affected_grams():
    """Grams that the bound does not cover are in the edited word too, at the same place or beside it."""
    rng = random.Random(9)
    for _ in range(3000):
        frequent = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) for _ in range(12)}
        frequent = {g for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}
        word = "".join(rng.choice("ab") for _ in range(rng.randint(5, 9)))
        at, kind = rng.randrange(len(word)), rng.choice("ird")
        other = word[:at] + {"i": rng.choice("abc") + word[at], "r": rng.choice("abc"), "d": ""}[kind] + word[at + 1:]
        if len(other) < 5 or other == word:
            continue
        a, b = spelling.grams_of(word, frequent), spelling.grams_of(other, frequent)
        shift = len(other) - len(word)
        places = {(g, p) for p, g in enumerate(b)}
        shared = sum((g, p) in places or (g, p + shift) in places for p, g in enumerate(a))
        assert shared >= len(a) - spelling.affected(a, len(word)) >= 1


def test_defined_cases(spark):
    texts = [None, "", "1234 ++", "abcde ABCDE Abcde abcdE", "abcdf " * 2, "abcdé " * 9, "house " * 3 + "houses " * 3, "xhouse " * 3, "four " * 9]
    rows = rows_of(spelling.spelling_variants(spark, clashing(docs(spark, texts, [(None, "abcde"), (3, "abcde")]))))
    # one letter from each other; equal counts have no form; A-Z alone is lowered; short words and rare words are no words
    assert rows == {("abcde", None, "abcde", 6, 1, None), ("abcdé", None, "abcdé", 9, 1, None), ("house", None, "house", 3, 2, None),
                    ("houses", None, "houses", 3, 1, None), ("xhouse", None, "xhouse", 3, 1, None)}
    assert spelling.spelling_variants(spark, docs(spark, ["a"]).where("false")).count() == 0


def test_ties_and_very_long_words(spark):
    long = "q" * 30_000
    words = {"mable": 3, "cable": 9, "table": 9, long: 3, long + "q": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group_words(spark, df)) == {
        ("mable", "cable", "cable", 3, 2, 9), ("cable", None, "cable", 9, 2, None), ("table", None, "table", 9, 2, None),
        (long, long + "q", long + "q", 3, 1, 7), (long + "q", None, long + "q", 7, 1, None)}
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("abcd", 3)], "word string, n long"))

import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.llm.helpers import clashing, docs

from lexidx.llm.lyndon import grouping, suffix_order
from lexidx.llm.runs import digest, find_runs, runs_of


def plain_runs(words, least=24, times=3):
    """Every stretch with every period, by definition."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        j = 0
        while j < n - q:
            if words[j] != words[j + q]:
                j += 1
                continue
            k = j
            while k < n - q and words[k] == words[k + q]:
                k += 1
            start, length = j, k + q - j
            stretch = words[start:start + length]
            if length >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, length, q))
            j = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def random_words(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 9])
    words = [rng.randint(0, k) for _ in range(n)]
    if n and rng.random() < .7:
        at, q = rng.randrange(n), rng.randint(1, 7)
        words = words[:at] + (words[at:at + q] * 90)[:n - at]
    if rng.random() < .3:
        words = words[:30] * 3
    return words


def test_groups_give_lyndon_array_and_suffix_order():
    rng = random.Random(5)
    for _ in range(800):
        s = random_words(rng)[:50]
        suffixes = [s[i:] for i in range(len(s))] + [[]]
        smaller = [next((j - i for j in range(i + 1, len(s) + 1) if suffixes[j] < suffixes[i])) for i in range(len(s))]
        lyndon, _, groups = grouping(np.array(s, np.int64))
        assert lyndon == smaller
        assert sorted(i for g in groups for i in g) == list(range(len(s)))
        assert suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_runs_against_definition():
    rng, seen = random.Random(7), 0
    for _ in range(600):
        words = random_words(rng)
        for least, times in ((24, 3), (3, 3), (8, 4)):
            expected = plain_runs(words, least, times)
            assert runs_of(np.array(words, np.int64), least, times) == expected
            seen += len(expected)
    assert seen > 1000


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), 2, 2)


def test_rows_against_definition(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{x}" for x in random_words(rng)) for _ in range(150)]
    texts += [None, "", " \t\n", "one", "x " * 40, "a b " * 30 + "  c", "the end of " * 12]
    rows = digest(find_runs(docs(spark, texts, [(3, texts[3]), (3, "y " * 30), (None, "z " * 30)]), loops=True)).collect()
    expected = sorted((repr(plain_row(i, t)) for i, t in [*enumerate(texts), (3, texts[3]), (3, "y " * 30), (None, "z " * 30)]))
    assert sorted(repr(tuple(r)) for r in rows) == expected


def test_awkward_tables(spark):
    empty = docs(spark, ["a"]).where("false")
    assert digest(find_runs(empty)).count() == 0
    table = clashing(docs(spark, ["a b c " * 20, None])).withColumnRenamed("score", "runs")
    rows = {r.doc_id: r for r in digest(find_runs(table)).collect()}
    assert (rows[0].n_runs, rows[0].start, rows[0].length, rows[0].period, rows[0].exponent_milli) == (1, 0, 60, 3, 20000)
    assert rows[1].n_runs == 0 and rows[1].period is None


def test_very_long_text(spark):
    long = "w " * 100_000 + " ".join(f"n{i}" for i in range(100_000)) + " " + "p q r s " * 25_000
    r = digest(find_runs(docs(spark, [long]))).first()
    assert (r.n_runs, r.start, r.length, r.period) == (2, 0, 100_000, 1)

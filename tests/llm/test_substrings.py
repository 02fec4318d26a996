import hashlib
import random

import numpy as np
import pytest
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs

from lexidx.llm import substrings

L = substrings.LENGTH


def plain(rows):
    """By definition: every string of L bytes, with the smallest document it starts in."""
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        if d is not None:
            for i in range(len(b) - L + 1):
                first[b[i:i + L]] = min(d, first.get(b[i:i + L], d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int8)
        if d is not None:
            for i in range(len(b) - L + 1):
                if first[b[i:i + L]] < d:
                    gone[i:i + L] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def found(df, **kw):
    return sorted(repr(tuple(r)) for r in substrings.digest(substrings.remove_repeats(df, **kw)).collect())


@pytest.fixture
def small_chunks(monkeypatch):
    """Many hot grams, few strings sorted together, short slices: every way that large inputs take."""
    monkeypatch.setattr(substrings, "MOST_STRINGS", 3)
    monkeypatch.setattr(substrings, "SORTED_SYMBOLS", 300)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 700)


def passages(rng):
    alphabet = "abcdefgh éß語 "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 160))) for _ in range(14)]


def mixed_rows(rng, n=120):
    pool, rows = passages(rng), []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.append(rng.choice([p, p[a:b], "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60)))]))
        rows.append((i, "".join(parts)))
    return rows


def test_corpus_against_definition(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert found(df) == plain([(r.doc_id, r.text) for r in df.collect()])


def test_mixed_passages(spark, small_chunks):
    rng = random.Random(2)
    rows = mixed_rows(rng)
    line = "one very common line that stands in a third of all texts, and more"
    rows += [(200 + i, rng.choice(["", "p", "some own words "]) + line + rng.choice(["", " q", " other"])) for i in range(60)]
    rows += [(300 + i, "a" * (45 + i)) for i in range(12)] + [(320, "ab" * 400), (321, "ba" * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, hot_least=4) == plain(rows)
    assert found(df) == plain(rows)


def test_defined_cases(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200))
    rows = [(5, text), (3, text), (3, text), (3, text[40:] + "other"), (9, "x" + text[10:80]), (None, text), (7, None), (8, ""), (2, "short"), (4, "short"),
            (1, text[:49]), (0, text[60:109]), (6, text[100:150])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(df) == plain(rows)
    assert found(docs(spark, ["a"]).where("false")) == []


def test_very_long_text(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    unlike = "".join(rng.choice("klmnop") for _ in range(9_000_000))
    rows = [(1, block + "tail"), (2, unlike[:4_200_000] + block[100:50_000] + unlike[4_200_000:]), (3, block[500:700])]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[1].removed] == []
    (span,) = got[2].removed
    # the passage, and at most what also agrees beside it
    assert span.start in range(4_199_990, 4_200_001) and span.end in range(4_249_900, 4_249_911)
    assert [tuple(s) for s in got[3].removed] == [(0, 200)]


def test_anchors_cover_every_window_alike():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))).encode() for _ in range(20)]
    data, h, number, position, first, last = substrings.anchors(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place = {}
    for n, p, a, b in zip(number.tolist(), position.tolist(), first.tolist(), last.tolist()):
        for w in range(a, b + 1):
            assert starts[n] <= w and w + L <= starts[n + 1] and w <= p <= w + L - substrings.GRAM
            assert place.setdefault(data[w:w + L].tobytes(), p - w) == p - w
    assert sum(last - first + 1) == sum(max(0, len(t) - L + 1) for t in texts)

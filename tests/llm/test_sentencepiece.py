"""Largest-score segmentation equals plain dynamic programming; decoding gives every text back."""

import random

import numpy as np

from lexidx.llm import queries, sentencepiece as sp
from tests.llm.helpers import SF_SMALL, clashing, docs


def brute(model, s):
    """All pieces tried at every position; the same tie rule (longer last piece)."""
    table = {p: (sc, i) for i, (p, sc, k) in enumerate(zip(model.pieces, model.scores, model.kinds)) if k == "normal"}
    longest = max(map(len, table))
    unknown = min(sc for sc, _ in table.values()) - 10
    best = [(0.0, None)] + [(float("-inf"), None)] * len(s)
    for e in range(1, len(s) + 1):
        for n in range(min(longest, e), 0, -1):
            piece = s[e - n:e]
            if piece in table and best[e - n][0] + table[piece][0] > best[e][0]:
                best[e] = (best[e - n][0] + table[piece][0], (n, table[piece][1]))
        if s[e - 1] not in table and best[e - 1][0] + unknown > best[e][0]:
            best[e] = (best[e - 1][0] + unknown, (1, -1))
    out, e = [], len(s)
    by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == "byte"}
    while e:
        n, i = best[e][1]
        out = ([i] if i >= 0 else [by_byte[b] for b in s[e - 1].encode()]) + out
        e -= n
    return out


def _ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_equals_dynamic_programming_and_round_trips():
    model = sp.Pieces.load()
    codec = model.codec()
    rnd = random.Random(11)
    texts = ["Hello  world", " lead", "tail ", "a\nb\tc\r\n", "中文 und ß é 🤗", "\x00\x01", "x" * 300, "   ", "The 1234 thing's"]
    texts += ["".join(rnd.choice("abcdehilnoprst ABC éß\n.,!1▁🤗") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    coded = codec.encode_all(texts)
    for t, c in zip(texts, coded, strict=True):
        assert codec.decode(_ids(c)) == t
        if sp.MARK not in t:
            assert _ids(c) == brute(model, sp.MARK + t.replace(" ", sp.MARK)), t
    # What a memory has seen changes nothing, nor does cutting texts into parts.
    assert codec.encode_all(texts) == coded
    whole = sp.Codec(model)
    whole.parts = None
    assert whole.encode_all(texts) == coded


def test_a_small_memory_forgets_without_harm(monkeypatch):
    texts = [f"word{i} and word{i % 7}" for i in range(200)]
    want = sp.Codec(sp.Pieces.load()).encode_all(texts)
    monkeypatch.setattr(sp, "MEMORY_PARTS", 5)
    monkeypatch.setattr(sp, "GROUP_CHARS", 40)
    assert sp.Codec(sp.Pieces.load()).encode_all(texts) == want


def test_edge_rows_and_whole_table(spark):
    rows = docs(spark, ["same text", None, "", "▁ mark", "same text"])
    got = sorted(sp.encode(clashing(rows), check=True).collect(), key=lambda r: r.doc_id)
    assert got[1].ids is None and got[1].n_tokens == 0 and got[1].round_trip is None
    assert got[2].ids == [] and got[2].round_trip is True and got[3].round_trip is True
    assert got[0].ids == got[4].ids and got[0].n_tokens == len(got[0].ids)
    assert sp.encode(rows.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(rows)).collect()}
    assert back == {r.doc_id: r.text for r in rows.collect()}
    out = queries.op7_sentencepiece(spark, SF_SMALL)
    assert out.where("not round_trip").count() == 0
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()

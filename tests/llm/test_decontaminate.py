"""Leaks equal a brute-force alignment of every text with every item."""

import random

import numpy as np

from lexidx.llm import decontaminate as dec, queries
from tests.llm.helpers import SF_SMALL, clashing, docs


def smith_waterman(item, passage):
    """Best local score, cell by cell."""
    above, best = [0] * (len(passage) + 1), 0
    for w in item:
        row = [0]
        for j, v in enumerate(passage):
            row.append(max(0, above[j] + (dec.MATCH if w == v else dec.MISMATCH), above[j + 1] + dec.GAP, row[j] + dec.GAP))
        above, best = row, max(best, max(row))
    return best


def test_alignment_equals_the_plain_table():
    rnd = random.Random(1)
    for _ in range(500):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))]
        p = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 25))]
        score, start, end = dec.align(np.array(a), np.array(p))
        assert score == smith_waterman(a, p)
        assert not score or smith_waterman(a, p[start:end]) == score


def test_whole_table_equals_brute_force(spark):
    texts = {r.doc_id: dec.words_of(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    items = {r.item_id: dec.words_of(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    coded = {d: number(ws) for d, ws in texts.items() if len(ws) < 3000}
    want = set()
    for i, ws in items.items():
        item, bag = number(ws), set(ws)
        for d, c in coded.items():
            if len(bag.intersection(texts[d])) < 0.4 * len(bag):  # an alignment of 0.4 needs that many common words
                continue
            if dec.align(item, c)[0] >= dec.LEAST * dec.MATCH * len(ws):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF_SMALL).collect()}
    assert {x for x in got if x[0] in coded} == want and want


def test_edited_copies_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 50))) for _ in range(30)]
    noise = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))

    def edited(text):
        return " ".join(w if rnd.random() > 0.12 else rnd.choice(["", "zz", w + " zz"]) for w in text.split())

    texts = [noise(50) + " " + edited(t).upper() + ". " + noise(80) for t in items] + [noise(200) for _ in range(30)]
    texts += [noise(100) + " " + items[0] + " " + noise(9) for _ in range(200)]  # one item nearly everywhere
    texts += [None, "", "..."]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    found = dec.leaks(clashing(docs(spark, texts)), clashing(bench.drop("n"))).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(k, k) for k in range(30)} <= got and {(60 + k, 0) for k in range(200)} <= got
    assert not {d for d, _ in got} & set(range(30, 60)) and not {d for d, _ in got} & {260, 261, 262}
    left = {r.doc_id for r in dec.drop_leaks(docs(spark, texts), bench).collect()}
    assert left == set(range(30, 60)) | {260, 261, 262}


def test_blocks_change_nothing_and_empty_tables(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon", "nothing here at all", "two words"]
    bench = spark.createDataFrame([(0, "Alpha, beta gamma delta!"), (1, "two words"), (2, "alpha beta gamma delta epsilon")],
                                  "item_id long, text string")
    whole = {tuple(r) for r in dec.leaks(docs(spark, texts), bench).collect()}
    assert {(r[0], r[1]) for r in whole} == {(0, 0), (2, 1), (0, 2)}
    monkeypatch.setattr(dec, "BLOCK_WORDS", 3)
    assert {tuple(r) for r in dec.leaks(docs(spark, texts), bench).collect()} == whole
    assert dec.leaks(docs(spark, texts), bench.limit(0)).count() == 0
    assert dec.leaks(docs(spark, texts).limit(0), bench).count() == 0


def test_no_alignment_goes_unseen():
    """Copies edited at regular and random places, against plain alignment of the whole text."""
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [say(rnd.randint(1, 40)) for _ in range(25)]

    def edits(ws):
        yield [v for w in ws for v in (w, "zz")]  # a word after every word
        yield [v for i, w in enumerate(ws) for v in ([w, "zz"] if i % 2 else [w])]
        yield ["zz" if i % 3 == 2 else w for i, w in enumerate(ws)]
        yield ["zz" if i % 2 else w for i, w in enumerate(ws)]
        yield [w for i, w in enumerate(ws) if i % 2]
        for rate in (0.2, 0.3, 0.4):
            yield [v for w in ws for v in rnd.choice([[w]] if rnd.random() > rate else [[], ["zz"], [w, rnd.choice(vocabulary)]])]

    texts = [say(rnd.randint(0, 30)) + e + say(rnd.randint(0, 30)) for ws in items for e in edits(ws)] + [say(400) for _ in range(5)]
    for least in (0.25, dec.LEAST, 0.7):
        block = dec.Items([(i, " ".join(ws)) for i, ws in enumerate(items)], least)
        counts = np.zeros(len(block.keys), np.int64)
        for ws in texts:
            counts[np.unique(block.hits(block.encode(ws))[1])] += 1
        find, near = dec.Finder(block, counts, least), 0
        for ws in texts:
            coded = block.encode(ws)
            scores = [dec.align(c, coded)[0] / (dec.MATCH * len(c)) for c in block.coded]
            assert {k: s for k, s, _, _ in find(" ".join(ws))} == {k: s for k, s in enumerate(scores) if s >= least}
            near += sum(least <= s < least + 0.1 for s in scores)
        assert near > 10


def test_copies_that_leave_no_run_of_three_words(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id").collect()
    items = [dec.words_of(r.text) for r in rows]
    inserted = [" ".join(w if i % 2 == 0 else w + " zzz" for i, w in enumerate(ws)) for ws in items]
    replaced = [" ".join(w if i % 3 != 2 else "zzz" for i, w in enumerate(ws)) for ws in items]
    texts = spark.createDataFrame([*enumerate(inserted + replaced)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(texts, spark.createDataFrame(rows)).collect()}
    want = {(d, r.item_id) for d, t in enumerate(inserted + replaced) for r, ws in zip(rows, items, strict=True)
            if smith_waterman_at_least(ws, t.split())}
    assert got == want and len(got) >= 2 * len(rows)


def smith_waterman_at_least(item, passage):
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    return dec.align(number(item), number(passage))[0] >= dec.LEAST * dec.MATCH * len(item)


def test_short_items_are_reported_but_take_nothing_out(spark):
    bench = spark.createDataFrame([(1, "the answer"), (2, "seven quick brown foxes jumped over lazy dogs"), (3, None), (4, "")], "item_id long, text string")
    df = docs(spark, ["the weather is fine", "well seven quick brown foxes jumped over lazy dogs", None])
    assert {r.item_id for r in dec.leaks(df, bench).collect()} == {1, 2}
    assert sorted(r.doc_id for r in dec.drop_leaks(df, bench).collect()) == [0, 2]
    assert sorted(r.doc_id for r in dec.drop_leaks(df, bench, least_words=1).collect()) == [2]
    assert {r.item_id for r in dec.short_items(bench).collect()} == {1, 3, 4}


def test_an_item_is_prepared_once_for_all_texts(monkeypatch):
    words = [f"w{i}" for i in range(30)]
    items = dec.Items([(1, " ".join(words)), (2, "other words of an item of its own")])
    find = dec.Finder(items, np.ones(len(items.keys), np.int64), dec.LEAST)
    asked, prepare = [], items._places
    monkeypatch.setattr(items, "_places", lambda k: asked.append(k) or prepare(k))
    texts = ["x " * n + " ".join(words) for n in range(5)]
    assert [find(t) for t in texts] == [[(0, 1.0, n, n + 30)] for n in range(5)]
    assert asked == [0]
    assert items.encode(["w0", "nowhere", "w2"]).tolist() == [1, 0, 3] and not len(items.encode([]))

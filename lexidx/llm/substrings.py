"""Repeated substrings: each byte covered by a string of ``LENGTH`` bytes that also starts in a document of smaller id.

Texts are bytes; strings never cross documents and are judged on the input. The
suffix array of a whole corpus fits in no task, so suffixes are first brought together by content:

1. Equal texts are one class, named by its smallest id. Of a class only that
   document's text goes on; the others are covered wholly (if they are long enough to be covered at all).
2. Every window of LENGTH bytes has an anchor: the gram of ``GRAM`` bytes in it with the
   smallest hash, the leftmost of equals. Equal windows have equal anchors at equal places, so windows
   can only be equal if their anchors are. Anchors whose gram stands in one class only are left out.
3. What is left travels as the anchor with its surroundings (all windows that it stands for) to the task
   of its gram. There, equal surroundings become one string. The strings of a gram are joined to a
   text, in which the gram with all that they share beside it is one symbol, and sorted by linear suffix grouping
   (``lyndon.suffix_order``). Equal windows are neighbours in the order, and each run of equals knows its smallest document.
4. Covered stretches go back to their class, are united, and cut from the text.

Hot grams: a count sketch of a size that follows the number of parts, not the data, knows the grams that would fill
much of a part. They are shared for sure, so step 2 does not post them, and in step 3 they are dealt over as many
tasks as they need. A task that has only some strings of a gram passes on, of every window, the rows
of its smallest document; an aggregate over those windows finds what other tasks hold. The same is done
where a gram has more than ``MOST_STRINGS`` different strings.

Defined cases: null is an empty text; texts shorter than LENGTH keep every byte; a very long text is worked on in
overlapping slices; rows that repeat an id are one document's texts (never covered by each other); a null id is no
document: nothing is removed from its row, and it covers nothing; an empty table gives no rows; columns
besides id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.llm.common import discard, staged
from lexidx.llm.lyndon import suffix_order
from lexidx.session import scratch_path

LENGTH = 50
GRAM = 24
SLICE_BYTES = 1 << 20       # bytes worked on at a time
PART_ANCHORS = 1_000_000    # posts in a part
POSTED_ANCHORS = 1_000_000  # posts dealt to parts at a time
POSTED_ROWS = 100_000       # the same for anchors with their surroundings
BLOCK_ROWS = 50_000         # of those, compared at a time
MOST_STRINGS = 4_000        # different strings of one gram sorted together
SORTED_SYMBOLS = 200_000    # symbols sorted together
HOT_SHARE = 4               # a slot with more than 1 / HOT_SHARE of an average part is hot,
HOT_LEAST = 5_000           # but not below this many anchors


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    span, done, out, factor = 1, 0, None, 0x9E3779B97F4A7C15
    while True:
        if size & span:
            if out is None:
                out = h
            else:
                n = len(data) - done - span + 1
                out = out[:n] * np.uint64(factor) + h[done:done + n]
            done += span
        if done == size:
            break
        n = len(h) - span
        h = h[:n] * np.uint64(factor) + h[span:span + n]
        h ^= h >> np.uint64(29)
        span, factor = span * 2, (factor * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) | 1
    out = out * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        n = len(out) - span
        out = np.minimum(out[:n], out[span:])
        span *= 2
    if span < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - span:])
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, hash, text number, position, first and last window start) of the anchors of some texts, in the bytes of all.

    The bytes of all texts together stay below 1 << 24.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none.astype(np.uint64), none, none, none, none
    number = np.repeat(np.arange(len(texts)), sizes)
    h = gram_hashes(data, GRAM)
    at = np.uint64(24)
    best = window_minima(((h >> at) << at) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
    inside = np.flatnonzero(number[:len(best)] == number[LENGTH - 1:LENGTH - 1 + len(best)])
    place = (best[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
    if not len(place):
        return data, none.astype(np.uint64), none, none, none, none
    # windows of one anchor follow each other
    fresh = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)))
    first, last = inside[fresh], inside[np.append(fresh[1:], len(inside)) - 1]
    position = place[fresh]
    return data, h[position] * np.uint64(0xD6E8FEB86659FD93), number[first], position, first, last


def slices(batches, columns: int):
    """Lists of rows (columns without the last; offset; bytes), of about SLICE_BYTES together; long texts in overlapping pieces."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            for values in zip(*(part.column(c).to_pylist() for c in range(columns))):
                text = values[-1] or b""
                for offset in range(0, max(1, len(text) - LENGTH + 1), SLICE_BYTES):
                    piece = text[offset:offset + SLICE_BYTES + LENGTH - 1]
                    rows.append((*values[:-1], offset, piece))
                    size += len(piece)
                    if size >= SLICE_BYTES:
                        yield rows
                        rows, size = [], 0
    if rows:
        yield rows


def text_classes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, written: list[str]) -> tuple[DataFrame, str]:
    """Rows (doc_id, cid, n_bytes); name of a table of classes (cid, cls, first_id, text), in buckets by cid so that texts are not exchanged again."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("cid"), "text")
    rows = src.select("doc_id", "cid", F.octet_length("text").cast("long").alias("n_bytes"))
    classes = (src.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).groupBy("cid")
               .agg(F.min("doc_id").cast("long").alias("first_id"), F.first("text").alias("text"))
               .select("cid", F.monotonically_increasing_id().alias("cls"), "first_id", "text"))
    path = scratch_path(spark, "substrings-texts")
    name = "lexidx_" + path.rsplit("-", 1)[1]
    classes.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "cid").option("path", path).saveAsTable(name)
    written.append(path)
    return rows, name


def slot_counts(classes: DataFrame, bits: int) -> np.ndarray:
    """How many anchors fall into each of 1 << bits slots."""
    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for rows in slices(batches, 1):
            h = anchors([r[-1] for r in rows])[1]
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    out = np.zeros(1 << bits, np.int64)
    rows = classes.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def gathered(pieces, most: int):
    """Tuples of arrays, put together until they are ``most`` long."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= most:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _by_part(part: np.ndarray):
    """(part, rows of it) for every part there is."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[order[a]]), order[a:b]


def shared_anchors(classes: DataFrame, parts: int, bits: int, hot) -> DataFrame:
    """(cls, position): the anchors whose gram stands in two classes at least, without the hot ones."""
    def post(batches):
        is_hot = np.unpackbits(np.frombuffer(hot.value, np.uint8)).astype(bool)

        def found():
            for rows in slices(batches, 2):
                _, h, number, position, _, _ = anchors([r[-1] for r in rows])
                keep = ~is_hot[(h >> np.uint64(64 - bits)).astype(np.int64)]
                h, number, position = h[keep], number[keep], position[keep]
                cls = np.array([r[0] for r in rows], np.int64)
                starts = np.concatenate([[0], np.cumsum([len(r[-1]) for r in rows])])[:-1]
                own = position - starts[number] + np.array([r[1] for r in rows], np.int64)[number]
                yield h, cls[number], own.astype(np.uint32)

        for h, cls, own in gathered(found(), POSTED_ANCHORS):
            out = ([], [], [], [])
            for p, chosen in _by_part(part_of(h, parts)):
                chosen = chosen[np.argsort(h[chosen])]
                for column, value in zip(out, (p, h[chosen].tobytes(), cls[chosen].tobytes(), own[chosen].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["part", "h", "cls", "at"])

    def share(group: pa.Table) -> pa.Table:
        h, cls, at = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("cls", np.int64), ("at", np.uint32)))
        order = np.lexsort((cls, h))
        h, cls, at = h[order], cls[order], at[order]
        begin = np.append(True, h[1:] != h[:-1])
        start = np.flatnonzero(begin)
        differ = cls[start] != cls[np.append(start[1:], len(h)) - 1]
        keep = differ[np.cumsum(begin) - 1]
        return pa.table({"cls": cls[keep], "position": at[keep].astype(np.int64)})

    posts = classes.select("cls", "text").mapInArrow(post, "part int, h binary, cls binary, at binary")
    return posts.groupBy("part").applyInArrow(share, "cls long, position long")


SIDE = LENGTH - GRAM        # bytes of a window beside its anchor
ROW = 2 + GRAM + 2 * SIDE   # bytes left and right; the anchor; what stands left (ending there) and right of it


def _rows_around(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One row of ROW bytes for each anchor: its windows' text, unused places zero."""
    left, right = position - first, last + LENGTH - position - GRAM
    out = np.zeros((len(position), ROW), np.uint8)
    out[:, 0], out[:, 1] = left, right
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, GRAM + 2 * SIDE)[position]
    place = np.arange(SIDE)
    out[:, 2:2 + GRAM] = around[:, SIDE:SIDE + GRAM]
    out[:, 2 + GRAM:2 + GRAM + SIDE] = np.where(place >= SIDE - left[:, None], around[:, :SIDE], 0)
    out[:, 2 + GRAM + SIDE:] = np.where(place < right[:, None], around[:, SIDE + GRAM:], 0)
    return out


def _first_of_equals(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal rows together, marks of where a new row starts in it). Equal rows may rarely start twice."""
    def words():
        for c in range(0, rows.shape[1], 8):
            wide = np.zeros((len(rows), 8), np.uint8)
            wide[:, :rows.shape[1] - c] = rows[:, c:c + 8]
            yield wide.view(np.uint64)[:, 0]

    name = np.zeros(len(rows), np.uint64)
    for w in words():
        name = (name ^ w) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(32)
    order = np.argsort(name, kind="stable")
    begin = np.append(True, np.zeros(max(0, len(rows) - 1), bool))[:len(rows)]
    for w in words():
        w = w[order]
        begin[1:] |= w[1:] != w[:-1]
    return order, begin


def _common(near: np.ndarray, used: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string, how many bytes beside the anchor all strings of its gram share; columns go away from the anchor."""
    head = np.repeat(start, size)
    agree = (near == near[head]) & used & used[head]
    return np.repeat(np.minimum.reduceat(np.logical_and.accumulate(agree, axis=1).sum(axis=1), start), size)


def _sorted_minima(strings: np.ndarray, gram: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    """out[string, bytes left of the anchor]: the smallest document that has this window, from the suffix order of the strings.

    ``strings`` come by gram. The anchor, with what all strings of its gram share beside it, is one symbol.
    """
    left, right = strings[:, 0].astype(np.int64), strings[:, 1].astype(np.int64)
    place = np.arange(SIDE)
    before_it, behind_it = strings[:, 2 + GRAM:2 + GRAM + SIDE], strings[:, 2 + GRAM + SIDE:]
    start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    size = np.diff(np.append(start, len(gram)))
    inner_left = _common(before_it[:, ::-1], place < left[:, None], start, size)
    inner_right = _common(behind_it, place < right[:, None], start, size)
    symbols = np.zeros((len(strings), 2 * SIDE + 2), np.int64)     # left, the anchor, right, an end
    symbols[:, :SIDE] = before_it.astype(np.int64) + 1
    symbols[:, SIDE] = 257 + gram
    symbols[:, SIDE + 1:-1] = behind_it.astype(np.int64) + 1
    used = np.ones(symbols.shape, bool)
    used[:, :SIDE] = (place >= SIDE - left[:, None]) & (place < SIDE - inner_left[:, None])
    used[:, SIDE + 1:-1] = (place < right[:, None]) & (place >= inner_right[:, None])
    text = symbols[used]
    number, before = np.nonzero(used)
    before = SIDE - before                                         # bytes left of the anchor, for a suffix that starts there
    order = suffix_order(text)
    text = np.append(text, np.zeros(2 * SIDE + 2, np.int64))
    # Windows that start left of the symbol: suffixes of their own, equal over the window's symbols.
    starts_window = (before > inner_left[number]) & (before >= SIDE - right[number])
    by = order[starts_window[order]]
    if len(by):
        string, a = number[by], before[by]
        need = a - inner_left[string] + 1 + np.maximum(0, SIDE - a - inner_right[string])
        same = np.ones(len(by) - 1, bool)
        for k in range(int(need.max())):
            same &= (text[by[1:] + k] == text[by[:-1] + k]) | (k >= need[1:])
        first = np.flatnonzero(np.append(True, ~same))
        out[string, a] = np.repeat(np.minimum.reduceat(doc[string], first), np.diff(np.append(first, len(by))))
    # Windows that start in it: they share what is left of the anchor, so they are equal as far as what follows the symbol is.
    by = order[before[order] == 0]
    string = number[by]
    shared, agree = np.zeros(len(by) - 1, np.int64), text[by[1:]] == text[by[:-1]]
    other_gram = ~agree
    for k in range(1, SIDE + 1):
        agree = agree & (text[by[1:] + k] == text[by[:-1] + k])
        shared += agree
    none = np.iinfo(np.int64).max
    for a in range(int(inner_left.max()) + 1):
        has = (a <= inner_left[string]) & (a >= SIDE - right[string])
        need = np.maximum(0, SIDE - a - inner_right[string])
        first = np.flatnonzero(np.append(True, other_gram | (shared < need[1:])))
        least = np.repeat(np.minimum.reduceat(np.where(has, doc[string], none), first), np.diff(np.append(first, len(by))))
        out[string[has], a] = least[has]


def covered(around: np.ndarray, doc: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one part, by bytes left of the anchor: is the window covered by a smaller document; must other tasks be asked."""
    order, begin = _first_of_equals(around)
    start = np.flatnonzero(begin)
    strings, string_of = around[order[start]], np.empty(len(around), np.int64)
    string_of[order] = np.cumsum(begin) - 1
    least = np.minimum.reduceat(doc[order], start)
    words = np.ascontiguousarray(strings[:, 2:2 + GRAM]).view(np.uint64)
    by_gram = np.lexsort(words.T)
    gram = np.cumsum(np.append(False, (words[by_gram[1:]] != words[by_gram[:-1]]).any(axis=1)))
    sizes = np.bincount(gram)
    minima = np.repeat(least[:, None], SIDE + 1, axis=1)
    ask = np.full(len(strings), split)
    # strings of one gram alone need no order; the others are sorted together, whole grams at a time
    chosen = np.flatnonzero(sizes[gram] > 1)
    weight = np.cumsum(2 + strings[by_gram[chosen], 0].astype(np.int64) + strings[by_gram[chosen], 1])
    at = 0
    while at < len(chosen):
        g = gram[chosen[at]]
        if sizes[g] > MOST_STRINGS:
            ask[by_gram[chosen[at:at + sizes[g]]]] = True
            ends = [min(k + MOST_STRINGS, at + sizes[g]) for k in range(at, at + sizes[g], MOST_STRINGS)]
        else:
            end = int(np.searchsorted(weight, weight[at] + SORTED_SYMBOLS))
            while end < len(chosen) and gram[chosen[end]] == gram[chosen[end - 1]]:
                end -= 1
            ends = [max(end, at + int(sizes[g]))]
        for end in ends:
            some = by_gram[chosen[at:end]]
            found = np.repeat(least[some][:, None], SIDE + 1, axis=1)
            _sorted_minima(strings[some], gram[chosen[at:end]] - g, least[some], found)
            minima[some] = found
            at = end
    k = np.arange(SIDE + 1)
    hit, asked = np.zeros((len(around), SIDE + 1), bool), np.zeros((len(around), SIDE + 1), bool)
    for at in range(0, len(around), BLOCK_ROWS):
        rows = slice(at, at + BLOCK_ROWS)
        left, right = around[rows, 0].astype(np.int64), around[rows, 1].astype(np.int64)
        window = (k <= left[:, None]) & (k >= SIDE - right[:, None])
        of, own = minima[string_of[rows]], doc[rows, None]
        hit[rows] = window & (of < own)
        asked[rows] = window & (of == own) & ask[string_of[rows]][:, None]
    return hit, asked


def covered_stretches(spark: SparkSession, classes: DataFrame, shared: DataFrame, parts: int, bits: int, hot, first_part, written: list[str]) -> DataFrame:
    """(cls, start, end): stretches that windows of smaller documents cover."""
    def post(batches):
        part_at = np.frombuffer(first_part.value, np.int32).reshape(2, -1)
        is_hot = np.unpackbits(np.frombuffer(hot.value, np.uint8)).astype(bool)

        def found():
            for turn, rows in enumerate(slices(batches, 4)):
                data, h, number, position, first, last = anchors([r[-1] for r in rows])
                cls, doc = (np.array([r[c] for r in rows], np.int64) for c in (0, 1))
                starts = np.concatenate([[0], np.cumsum([len(r[-1]) for r in rows])])[:-1]
                offset = np.array([r[3] for r in rows], np.int64)
                slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                listed = np.zeros(len(data) + 1, bool)
                for r, s in zip(rows, starts.tolist()):
                    if r[2]:
                        at = np.asarray(r[2], np.int64) - r[3] + s
                        listed[at[(at >= s) & (at < s + len(r[-1]))]] = True
                keep = is_hot[slot] | listed[position]
                h, number, position, first, last, slot = (x[keep] for x in (h, number, position, first, last, slot))
                part = np.where(is_hot[slot], part_at[0, slot] + turn % np.maximum(part_at[1, slot], 1), part_of(h, parts))
                yield (part, _rows_around(data, position, first, last), cls[number], doc[number],
                       (position - starts[number] + offset[number]).astype(np.uint32))

        for part, around, cls, doc, own in gathered(found(), POSTED_ROWS):
            out = ([], [], [], [], [])
            for p, chosen in _by_part(part):
                packed = pa.compress(around[chosen].tobytes(), codec="zstd", asbytes=True)
                for column, value in zip(out, (p, packed, cls[chosen].tobytes(), doc[chosen].tobytes(), own[chosen].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])],
                                             ["part", "around", "cls", "doc", "at"])

    def settle(group: pa.Table) -> pa.Table:
        cls, doc, at = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("cls", np.int64), ("doc", np.int64), ("at", np.uint32)))
        around = np.concatenate([
            np.frombuffer(pa.decompress(b, decompressed_size=len(c) // 8 * ROW, codec="zstd", asbytes=True), np.uint8).reshape(-1, ROW)
            for b, c in zip(group.column("around").to_pylist(), group.column("cls").to_pylist())])
        hit, ask = covered(around, doc, group.column("part")[0].as_py() >= parts)
        # windows that follow each other are one stretch; more bytes left of the anchor means an earlier start
        edge = np.zeros((len(hit), SIDE + 3), np.int8)
        edge[:, 1:-1] = hit
        step = np.diff(edge, axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        at = at.astype(np.int64)
        start, end = at[row] - (high - 1), at[row] - low + LENGTH
        asked, k = np.nonzero(ask)
        strings = None
        if len(asked):
            line = np.concatenate([around[:, 2 + GRAM:2 + GRAM + SIDE], around[:, 2:2 + GRAM], around[:, 2 + GRAM + SIDE:]], axis=1)
            strings = [line[r, SIDE - n:SIDE - n + LENGTH].tobytes() for r, n in zip(asked.tolist(), k.tolist())]
        return pa.table({
            "window": pa.array([None] * len(row) + (strings or []), pa.binary()),
            "cls": np.concatenate([cls[row], cls[asked]]), "doc": np.concatenate([doc[row], doc[asked]]),
            "start": np.concatenate([start, at[asked] - k]), "end": np.concatenate([end, at[asked] - k + LENGTH])})

    at = shared.groupBy("cls").agg(F.collect_list("position").alias("positions"))
    if any(hot.value):  # hot anchors are in no list, so every class has to be looked through
        wanted = classes.select("cls", "cid").join(at, "cls", "left").select("cid", "positions")
        kind = "left"
    else:
        wanted, kind = classes.select("cls", "cid").join(at, "cls").select("cid", "positions"), "inner"
    posts = (classes.join(wanted.hint("shuffle_hash"), "cid", kind).select("cls", "first_id", "positions", "text")
             .mapInArrow(post, "part int, around binary, cls binary, doc binary, at binary"))
    found = staged(spark, posts.groupBy("part").applyInArrow(settle, "window binary, cls long, doc long, start long, end long"),
                   "substrings-found", written)
    asked = found.where("window is not null")
    least = asked.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "least")
    return found.where("window is null").select("cls", "start", "end").union(
        asked.join(least, "window").where("doc > least").select("cls", "start", "end"))


def cut_texts(classes: DataFrame, stretches: DataFrame) -> DataFrame:
    """(cid, first_id, removed, kept_sha256) of every class."""
    def cut(batches):
        for rows in _small(batches):
            removed, digests = [], []
            for text, start, end in zip(*(rows.column(c).to_pylist() for c in (2, 3, 4))):
                spans, kept, at = [], [], 0
                if start:
                    by = np.lexsort((end, start))
                    s, e = np.array(start)[by], np.maximum.accumulate(np.array(end)[by])
                    fresh = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    for a, b in zip(s[fresh].tolist(), e[np.append(fresh[1:], len(s)) - 1].tolist()):
                        spans.append({"start": a, "end": b})
                        kept.append(text[at:a])
                        at = b
                kept.append(text[at:])
                removed.append(spans)
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests)],
                ["cid", "first_id", "removed", "kept_sha256"])

    by_class = stretches.groupBy("cls").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = classes.select("cls", "cid").join(by_class, "cls").select("cid", "starts", "ends")
    return (classes.join(spans.hint("shuffle_hash"), "cid", "left").select("cid", "first_id", "text", "starts", "ends")
            .mapInArrow(cut, "cid binary, first_id long, removed array<struct<start:long,end:long>>, kept_sha256 string"))


def _small(batches, rows: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, n_bytes, removed, kept_sha256) for every row: the maximal removed stretches [start, end) and the digest of the rest."""
    spark = docs.sparkSession
    written: list[str] = []
    rows, name = text_classes(spark, docs, id_col, text_col, written)
    classes = spark.table(name)
    total = classes.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * total // (LENGTH - GRAM + 2)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // PART_ANCHORS))
    bits = max(18, parts.bit_length() + 4)
    counts = slot_counts(classes, bits)
    limit = max(hot_least, int(counts.sum()) // parts // HOT_SHARE)
    is_hot = counts > limit
    tasks = np.where(is_hot, -(-counts // limit), 0)
    first = np.cumsum(tasks) - tasks + parts
    sc = spark.sparkContext
    hot = sc.broadcast(np.packbits(is_hot).tobytes())
    first_part = sc.broadcast(np.stack([first, tasks]).astype(np.int32).tobytes())
    shared = staged(spark, shared_anchors(classes, parts, bits, hot), "substrings-shared", written)
    stretches = covered_stretches(spark, classes, shared, parts, bits, hot, first_part, written)
    done = staged(spark, cut_texts(classes, stretches), "substrings-classes")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, written)
    none = F.array().cast("array<struct<start:long,end:long>>")
    own = rows.join(done.withColumnRenamed("cid", "of"), F.col("cid") == F.col("of"), "left")
    intact = F.col("of").isNull() | F.col("doc_id").isNull()
    copy = F.col("doc_id").cast("long") > F.col("first_id")
    return own.select(
        "doc_id", "n_bytes",
        F.when(intact, none).when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.col("removed")).alias("removed"),
        F.when(intact, F.lower(F.hex("cid"))).when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes",
                        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), "kept_sha256")

"""SentencePiece encoding and decoding with a given model.

All pieces sit in one Aho-Corasick automaton. A single pass over the text
follows its output links: at every position each piece that ends there relaxes
the best score, so the segmentation has the largest sum of piece scores
(Viterbi). Characters without a piece of their own compete as unknown, ten
below the lowest score, and are written as their UTF-8 byte pieces.

Texts are cut where no piece can reach across (before a run of word marks, and
around characters that occur in no longer piece); the parts are encoded
independently, which changes nothing in the result, and parts seen before come
from a bounded memory. Where a model has pieces that reach across, the whole
text is one part.

Ties go to the longer last piece. A null text has null ids and stays null; an
empty text has no ids. A literal word mark (U+2581) in a text is written as its
three bytes, so decoding gives back every text exactly. Repeated rows give
repeated results, an empty table none; other columns pass or are dropped as stated.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.llm.common import Shipped, sliced

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMORY_PARTS = 200_000
MEMORY_PART_CHARS = 48
GROUP_CHARS = 1_000_000
SOLVE_CELLS = 60_000
CUT_CHARS = "\n\t\r"


class Pieces:
    """What encoding needs of a model: a plain table that can be shipped to workers."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self._codec = None

    @staticmethod
    def load(path: str = MODEL_PATH) -> Pieces:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = ["byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i)
                 else "unused" if m.is_unused(i) else "normal" for i in range(n)]
        return Pieces([m.id_to_piece(i) for i in range(n)], [float(m.get_score(i)) for i in range(n)], kinds)

    def codec(self) -> Codec:
        """Built once in each worker: the table outlives the tasks that share it."""
        if self._codec is None:
            self._codec = Codec(self)
        return self._codec


class Automaton:
    """Aho-Corasick over the pieces as arrays, so that many parts advance at once.

    ``start`` gives the state after a character met in the root. Characters
    that occur inside pieces have a column in ``step``, the completed transition
    table; all others lead back to ``start``. ``first`` is the state's longest
    piece ending here (itself or its nearest output link), ``link`` the next
    shorter one, 0 where there is none.
    """

    def __init__(self, words: list[str], scores: list[float], ids: list[int]):
        children: list[dict[str, int]] = [{}]
        end = [-1]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    end.append(-1)
                at = nxt
            end[at] = k
        n = len(children)
        inner = sorted({c for w in words for c in w[1:]})
        column = {c: j for j, c in enumerate(inner)}
        self.column = np.full(0x110000, -1, np.int32)
        self.start = np.zeros(0x110000, np.int32)
        for c, j in column.items():
            self.column[ord(c)] = j
        for c, state in children[0].items():
            self.start[ord(c)] = state
        self.step = np.zeros((n, max(1, len(inner))), np.int32)
        for c, state in children[0].items():
            if c in column:
                self.step[0, column[c]] = state
        fail, self.first, self.link = [0] * n, np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = list(children[0].values())
        for s in queue:  # in order of depth; the list grows while it is read
            f = fail[s]
            self.step[s] = self.step[f]
            self.first[s] = s if end[s] >= 0 else self.first[f]
            if end[s] >= 0:
                self.link[s] = self.first[f]
            for c, child in children[s].items():
                fail[child] = int(self.step[f, column[c]])
                self.step[s, column[c]] = child
                queue.append(child)
        end = np.array(end)
        has = end >= 0
        self.length, self.score, self.ident = np.zeros(n, np.int32), np.zeros(n), np.full(n, -1, np.int32)
        self.length[has] = np.array([len(w) for w in words], np.int32)[end[has]]
        self.score[has] = np.array(scores)[end[has]]
        self.ident[has] = np.array(ids, np.int32)[end[has]]


class Codec:
    """Encoder and decoder over a piece table; lives in a worker."""

    def __init__(self, model: Pieces):
        normal = [i for i, k in enumerate(model.kinds) if k == "normal"]
        words = [model.pieces[i] for i in normal]
        self.automaton = Automaton(words, [model.scores[i] for i in normal], normal)
        self.is_single = np.zeros(0x110000, bool)
        self.is_single[[ord(w) for w in words if len(w) == 1]] = True
        self.unknown_score = min(model.scores[i] for i in normal) - 10.0
        self.byte_id = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == "byte"}
        self.unknown_id = model.kinds.index("unknown")
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b""
                    for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.parts = self._cutter(words)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _cutter(pieces: list[str]):
        """A pattern whose matches partition a text at places no piece reaches across, or None."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            return None
        alone = "".join(c for c in CUT_CHARS if not any(c in p and len(p) > 1 for p in pieces))
        cut = f"|[{alone}]" if alone else ""
        return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{cut}")

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown_id) for b in c.encode()]

    def solve(self, parts: list[str]) -> list[bytes]:
        """The best segmentation of each part, as little-endian 32-bit ids."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        at = 0
        while at < len(order):  # parts of about one length advance together, in bounded tables
            most = sizes[at] * 1.25 + 2
            to = min(np.searchsorted(sizes, most, "right"), at + max(1, int(SOLVE_CELLS // (most + 1))))
            group = order[at:to].tolist()
            for i, ids in zip(group, self._solve_group([parts[i] for i in group]), strict=True):
                out[i] = ids
            at = to
        return out

    def _solve_group(self, parts: list[str]) -> list[bytes]:
        a = self.automaton
        sizes = np.array([len(p) for p in parts])
        w, n = len(parts), int(sizes.max(initial=0))
        chars = np.zeros((n, w), np.uint32)  # one row for each position, padded at the end
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        who = np.repeat(np.arange(w), sizes)
        chars[np.arange(len(flat)) - offsets[who], who] = flat
        best = np.full((n + 1, w), -np.inf)
        best[0] = 0.0
        length, ident = np.zeros((n + 1, w), np.int32), np.full((n + 1, w), -1, np.int32)
        state = np.zeros(w, np.int32)
        for e in range(1, n + 1):
            c = chars[e - 1]
            column = a.column[c]
            state = np.where(column >= 0, a.step[state, np.maximum(column, 0)], a.start[c])
            output = a.first[state]
            live = np.flatnonzero(output)
            while len(live):  # follow the output links, the longest piece first
                o = output[live]
                total = best[e - a.length[o], live] + a.score[o]
                better = total > best[e, live]
                k = live[better]
                best[e, k], length[e, k], ident[e, k] = total[better], a.length[o[better]], a.ident[o[better]]
                output[live] = a.link[o]
                live = live[output[live] > 0]
            unknown = np.flatnonzero(~self.is_single[c])
            if len(unknown):
                total = best[e - 1, unknown] + self.unknown_score
                k = unknown[total > best[e, unknown]]
                best[e, k], length[e, k], ident[e, k] = best[e - 1, k] + self.unknown_score, 1, -1
        at, cols, taken = sizes.copy(), np.arange(w), np.zeros(w, np.int64)
        tokens = np.zeros((w, n), np.int32)  # filled from the right
        ends = np.zeros((w, n), np.int32)
        while len(live := cols[at[cols] > 0]):
            taken[live] += 1
            tokens[live, n - taken[live]] = ident[at[live], live]
            ends[live, n - taken[live]] = at[live]
            at[live] -= length[at[live], live]
            cols = live
        strange = set(np.flatnonzero((tokens == -1).any(axis=1)).tolist())
        out = []
        for i, t in enumerate(taken.tolist()):
            ids = tokens[i, n - t:]
            if i in strange:
                full: list[int] = []
                for x, e in zip(ids.tolist(), ends[i, n - t:].tolist(), strict=True):
                    full += [x] if x >= 0 else self._bytes(parts[i][e - 1])
                ids = np.array(full, np.int32)
            out.append(ids.tobytes())
        return out

    def _learn(self, parts: set[str]) -> list[str]:
        """Get all these parts into the memory; returns those too long to be kept there."""
        new = parts.difference(self.memory)
        again = new.intersection(self.older)
        self.memory.update((p, self.older[p]) for p in again)
        new = list(new - again)
        self.memory.update(zip(new, self.solve(new), strict=True))
        return [p for p in new if len(p) > MEMORY_PART_CHARS]

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian 32-bit integers; None for None."""
        out: list[bytes | None] = []
        group: list[str | None] = []
        chars = 0
        for t in texts:
            group.append(t)
            chars += len(t or "")
            if chars >= GROUP_CHARS:
                out += self._encode_group(group)
                group, chars = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str | None]) -> list[bytes | None]:
        literal = array("i", self._bytes(MARK)).tobytes()
        cut: list[list[list[str]]] = []  # for each text its runs between literal marks, each run its parts
        for t in texts:
            runs = []
            for k, run in enumerate((t or "").split(MARK) if t else []):
                s = run.replace(" ", MARK) if k else MARK + run.replace(" ", MARK)
                runs.append(([s] if s else []) if self.parts is None else self.parts.findall(s))
            cut.append(runs)
        if len(self.memory) >= MEMORY_PARTS:  # parts not met again since the last turn are forgotten
            self.older, self.memory = self.memory, {}
        seen: set[str] = set()
        for runs in cut:
            for run in runs:
                seen.update(run)
        long = self._learn(seen)
        get = self.memory.__getitem__
        coded = [None if t is None else literal.join([b"".join(map(get, run)) for run in runs])
                 for t, runs in zip(texts, cut, strict=True)]
        for p in long:
            del self.memory[p]
        return coded

    def decode(self, ids) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _shipped(spark: SparkSession, model_path: str):
    """The piece table as a broadcast variable; its size is the vocabulary's, never the data's."""
    return Shipped(spark, Pieces.load(model_path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH,
           check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): a null text gives null ids and 0 tokens.

    With ``check`` a column ``round_trip`` says whether decoding the ids gives
    back the very text (null for a null text).
    """
    pieces = _shipped(docs.sparkSession, model_path)

    def run(batches):
        codec = pieces.value.codec()
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            coded = codec.encode_all(texts)
            sizes = np.array([len(c) // 4 if c else 0 for c in coded], np.int64)
            flat = np.frombuffer(b"".join([c for c in coded if c]), np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            null = np.array([c is None for c in coded], bool)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
            cols, names = [batch.column(0), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"]
            if check:
                cols.append(pa.array([None if t is None else codec.decode(np.frombuffer(c, np.int32).tolist()) == t
                                      for t, c in zip(texts, coded, strict=True)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>"
    return src.mapInArrow(run, schema + (", round_trip boolean" if check else ""))


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """(id, text) from ids; null ids give a null text, ids outside the vocabulary fail."""
    pieces = _shipped(coded.sparkSession, model_path)

    def run(batches):
        codec = pieces.value.codec()
        for batch in sliced(batches):
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    src = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")

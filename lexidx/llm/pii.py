"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and stops at anchors only:
at-signs, plus signs, digits, URI schemes and identifier cues. At an anchor a
small local parser expands to the boundaries and validates what it found.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base kinds; they equal a
leftmost non-overlapping scan of their patterns, with failing matches dropped.
The method adds ``address`` (a URI that carries a user name, or mailto/tel/sip),
``account`` (IBAN, social security or account number behind a cue) and
``secret`` (a quoted or long value behind a credential cue).

Defined cases: a null text has no spans; very long texts are walked in one
linear pass; repeated rows give repeated results; an empty table gives none;
columns other than the id and the text do not take part. Offsets count code
points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.llm.common import per_batch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")

# The base patterns and the cue words.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:", "sip:")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security")
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")

_DIGITS = re.compile(r"[0-9]+")
_URI_REST = re.compile(r"[^\s\"'<>]+")
_NO_STOP = re.compile(r"[^\s/@\"'<>]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"[0-9]([\x20-]?[0-9]){7,16}(?![0-9])")
_ACCOUNT_GAP = re.compile(r"[\x20]*(number|no\.?|nr\.?|num)?[\x20]*[:#=]*[\x20]*", re.IGNORECASE)
_SECRET_VALUE = re.compile(r"[\x20]*[:=][\x20]*(\"([^\"\s]{12,})\"|'([^'\s]{12,})'|([A-Za-z0-9_+/=-]{20,}))")


_BUILT: dict = {}  # the automaton, once in every process


def _automaton():
    if _BUILT:
        return _BUILT[0]
    import ahocorasick
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in (w, w.upper(), w.capitalize(), w.title()):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    _BUILT[0] = a
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _valid_iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in one text, each kind in order of its start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    after = dict.fromkeys(KINDS, 0)
    run_end, run_is_user = -1, False  # the stretch without stops behind a scheme; schemes inside it share its end
    for last, (kind, width) in _automaton().iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= after["ip"]:
                m = IP.match(text, at)
                if m:
                    after["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        found["ip"].append(m.span())
                else:  # no other start inside this run of digits can do better
                    after["ip"] = _DIGITS.match(text, at).end()
            if at >= after["card"]:
                m = CARD.match(text, at)
                if m:
                    after["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL_PART:
                start -= 1
            m = EMAIL.match(text, start) if start < at else None
            if m:
                after["email"] = m.end()
                found["email"].append(m.span())
        elif kind == "plus":
            m = PHONE.match(text, at)
            if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
        elif kind == "scheme" and at >= after["address"]:
            if at and (text[at - 1].isalnum()):
                continue
            # The rest of the URI is read only where a span comes of it, and every stretch without stops once.
            after_it = text[last + 1:last + 2]
            if last + 1 >= run_end:
                run_end = _NO_STOP.match(text, last + 1).end()
                run_is_user = text[run_end:run_end + 1] == "@" and _NO_STOP.match(text, run_end + 1).end() > run_end + 1
            if text[last] == ":" and (after_it.isalnum() or after_it == "+") or run_is_user and last + 1 < run_end:
                end = last + 1 + len(_URI_REST.match(text, last + 1).group().rstrip(".,;:!?)"))
                after["address"] = end
                found["address"].append((at, end))
        elif kind == "account" and at >= after["account"]:
            gap = _ACCOUNT_GAP.match(text, last + 1).end()
            for pattern in (_IBAN, _SSN, _NUMBER):
                m = pattern.match(text, gap)
                if m and (pattern is not _IBAN or _valid_iban(m.group())):
                    after["account"] = m.end()
                    found["account"].append(m.span())
                    break
        elif kind == "secret" and at >= after["secret"]:
            m = _SECRET_VALUE.match(text, last + 1)
            if m:
                g = next(i for i in (2, 3, 4) if m.group(i) is not None)
                after["secret"] = m.end()
                found["secret"].append(m.span(g))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base spans, all spans."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_spans(t) for t in batch.column(1).to_pylist()]
        cols = [batch.column(0)]
        cols += [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE_KINDS]
        cols.append(pa.array([hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found]))
        cols.append(pa.array([joined(f, KINDS) for f in found], pa.string()))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, "
              + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")
    return src.mapInArrow(per_batch(run), schema)


def redacted_text(text: str) -> str:
    """The text with every span replaced by ``<KIND>``; overlapping spans become one."""
    found = find_spans(text)
    spans = sorted((s, -e, KINDS.index(k)) for k in KINDS for s, e in found[k])
    out, at = [], 0
    for s, neg_end, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = -neg_end
        elif -neg_end > at:  # reaches beyond the span before it
            at = -neg_end
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced; a null text stays null.

    ``chars_col``, where the table has it, is set to the new length.
    """
    names = docs.columns
    t = names.index(text_col)
    n = names.index(chars_col) if chars_col in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else redacted_text(x) for x in batch.column(t).to_pylist()]
        cols = list(batch.columns)
        cols[t] = pa.array(texts, pa.string())
        if n is not None:
            old = cols[n].to_pylist()
            cols[n] = pa.array([o if x is None else len(x) for x, o in zip(texts, old, strict=True)], cols[n].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(per_batch(run), docs.schema)

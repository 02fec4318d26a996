"""Base spans equal a plain scan of the patterns; cues add spans; redaction removes them."""

import hashlib
import random
import re
import time

from lexidx.llm import pii, queries
from tests.llm.helpers import SF_SMALL, clashing, docs

MIXED = "0123456789.+@-a() \n1255é𝒳"


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split(".")),
          "card": lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and _luhn(s),
          "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text or "") if ok[k](m.group())] for k, p in out.items()}


def test_base_spans_equal_a_plain_scan_on_random_texts():
    rnd = random.Random(5)
    for _ in range(20000):
        text = "".join(rnd.choice(MIXED) for _ in range(rnd.randint(0, 45)))
        found = pii.find_spans(text)
        assert {k: found[k] for k in pii.BASE_KINDS} == brute(text), text


def test_long_runs_stay_linear():
    text = "7" * 30000 + "@" + "a@" * 20000 + "1." * 20000 + "+1" + "." * 30000
    found = pii.find_spans(text)
    assert found["card"] == found["phone"] == [] and found["email"] == [(69999, 110000)]
    assert len(found["ip"]) == 5000  # the chain is cut into groups of four


def test_cues_add_validated_spans():
    text = ('IBAN: DE89 3704 0044 0532 0130 00 and IBAN: DE00 3704 0044 0532 0130 00, account number 12345678901, SSN 123-45-6789, '
            'mailto:x@y.org, https://user:pw@host.example/path, https://host.example/path, token = "9b0b3c6a43eb78aa99cb"')
    found = pii.find_spans(text)
    said = {k: [text[s:e] for s, e in found[k]] for k in ("address", "account", "secret")}
    assert said["account"] == ["DE89 3704 0044 0532 0130 00", "12345678901", "123-45-6789"]
    assert said["address"] == ["mailto:x@y.org", "https://user:pw@host.example/path"]
    assert said["secret"] == ["9b0b3c6a43eb78aa99cb"]
    assert pii.find_spans("Licensed under CC BY-NC 4.0. The account of a token on a page; see 3.2.1.")["account"] == []


def test_long_joined_uris_stay_linear():
    """No stretch is read again for every scheme in it."""
    for piece in ("http://a.org/x,", "mailto:-", "mailto:", "ftp://u@", "https://x:y", "sip:@", "tel:/", "http://user:pw@h/"):
        text = piece * (1_000_000 // len(piece))
        began = time.time()
        pii.find_spans(text)
        assert time.time() - began < 5, piece
    assert pii.find_spans("mailto:-x@y http://u:p@h/ http://h/u@h mailto:tel:-u@ h")["address"] == [(0, 11), (12, 25), (39, 53)]


def test_user_names_in_uris_equal_a_plain_match():
    rng = random.Random(1)
    user = re.compile(r"[^\s/@\"'<>]+@[^\s/@\"'<>]")
    for _ in range(3000):
        text = "".join(rng.choice(["http://", "mailto:", "sip:", "u", "-", "@", "/", " ", "."]) for _ in range(14))
        expected, after = [], 0
        for m in re.finditer("(?=(http://|mailto:|sip:))", text):
            at, last = m.start(), m.start() + len(m.group(1))
            if at < after or at and text[at - 1].isalnum():
                continue
            rest = re.compile(r"[^\s\"'<>]+").match(text, last)
            if rest and (m.group(1)[-1] == ":" and (rest.group()[0].isalnum() or rest.group()[0] == "+") or user.match(text, last)):
                after = last + len(rest.group().rstrip(".,;:!?)"))
                expected.append((at, after))
        assert pii.find_spans(text)["address"] == expected, text


def test_query_over_the_whole_table_and_edge_rows(spark):
    rows = docs(spark, ["mail a@b.co now", None, "", "𝒳 10.0.0.1"], [(0, "mail a@b.co now")])
    got = sorted(pii.detect(clashing(rows)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got] == [
        (0, 1, 0, "email:5:11"), (0, 1, 0, "email:5:11"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "ip:2:10")]
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(rows.limit(0)).count() == 0
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op3_pii(spark, SF_SMALL).collect()
    assert len(out) == len(table)
    for r in out:
        b = brute(table[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(b[k]) for k in pii.BASE_KINDS)
        line = ",".join(f"{k}:{s}:{e}" for k in pii.BASE_KINDS for s, e in b[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_redaction_keeps_columns_and_removes_every_base_span(spark):
    rows = docs(spark, ["call +1 (555) 555-0100 or a@b.co", None, "", "clean text"])
    got = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert got[0].text == "call <PHONE> or <EMAIL>" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[1].n_chars is None and got[3].text == "clean text"
    assert pii.redact(clashing(rows)).columns == clashing(rows).columns

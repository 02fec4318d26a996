"""Randomized differential test of the coercions against the Java rules,
restated in a few lines of Python (one Spark job for all cases)."""

import json
import random
import re

from lexidx.operators import validate
from lexidx.operators.schema import fields_of
from lexidx.sources import ndjson
from tests.conftest import write_lines

FIELDS = fields_of([("l", "long"), ("d", "double"), ("b", "boolean")])
LMIN, LMAX = -(2 ** 63), 2 ** 63 - 1


def java_trim(s):
    i, j = 0, len(s)
    while i < j and ord(s[i]) <= 32:
        i += 1
    while j > i and ord(s[j - 1]) <= 32:
        j -= 1
    return s[i:j]


def expect_long(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, int):
        return v
    if isinstance(v, str):
        t = java_trim(v)
        if re.fullmatch(r"[+-]?[0-9]+", t) and LMIN <= int(t) <= LMAX:
            return int(t)
    return None


def expect_bool(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, str) and java_trim(v).lower() in ("true", "false"):
        return java_trim(v).lower() == "true"
    return None


def test_random_coercions(spark, tmp_dir):
    rnd = random.Random(11)
    pad = lambda s: rnd.choice(["", " ", "\t", "  "]) + s + rnd.choice(["", " ", "\n"])
    cases = []
    for _ in range(150):
        cases.append(("l", rnd.randint(LMIN, LMAX)))
        cases.append(("l", pad(rnd.choice(["", "+", "-"]) + str(rnd.randint(0, 10 ** rnd.randint(1, 20))))))
        cases.append(("l", rnd.choice(["1.5", "abc", "1e3", "", "--1", "0x10"])))
        x = rnd.uniform(-1e6, 1e6)
        cases.append(("d", x))
        cases.append(("d", pad(repr(round(x, rnd.randint(0, 8))))))
        word = rnd.choice(["true", "false", "yes", "1", "t"])
        cases.append(("b", pad("".join(c.upper() if rnd.random() < 0.5 else c for c in word))))
        cases.append(("b", rnd.choice([True, False])))
    lines = [json.dumps({f: v}) for f, v in cases]
    v = validate.validate(ndjson.parse(ndjson.read_lines(spark, write_lines(tmp_dir, lines))), FIELDS)
    got = {r.line: r for r in validate.values(v, FIELDS).select("line", "doc.*").collect()}
    for i, (f, val) in enumerate(cases, start=1):
        r = got[i]
        if f == "l":
            assert r.l == expect_long(val), (val, r.l)
        elif f == "d":
            want = float(java_trim(val)) if isinstance(val, str) else float(val)
            assert r.d == want, (val, r.d)
        else:
            assert r.b == expect_bool(val), (val, r.b)

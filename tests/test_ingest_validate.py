"""Scan, decode, validate and coerce (the reference's mapper and builder cases)."""

from pyspark.sql import functions as F

from lexidx.operators import validate
from lexidx.operators.schema import fields_of
from lexidx.sources import ndjson
from tests.conftest import write_lines

F1 = fields_of([("title", "text"), ("tag", "keyword"), ("count", "long")])
ALL = fields_of([("k", "keyword"), ("t", "text"), ("l", "long"), ("d", "double"), ("b", "boolean")])


def _validated(spark, tmp_dir, lines, fields):
    path = write_lines(tmp_dir, lines)
    return validate.validate(ndjson.parse(ndjson.read_lines(spark, path)), fields)


def test_blank_lines_skipped_but_counted(spark, tmp_dir):
    lines = ['{"title": "a"}', "", "   ", '{"title": "b"}']
    got = ndjson.read_lines(spark, write_lines(tmp_dir, lines)).orderBy("line").collect()
    assert [(r.line, r.value) for r in got] == [(1, '{"title": "a"}'), (4, '{"title": "b"}')]


def test_no_break_space_is_content(spark, tmp_dir):
    got = ndjson.read_lines(spark, write_lines(tmp_dir, [" ", "{}"])).collect()
    assert sorted(r.line for r in got) == [1, 2]


def test_physical_lines_across_many_splits(spark, tmp_dir):
    lines = [("" if i % 7 == 0 else f'{{"title": "doc {i}"}}') for i in range(3000)]
    path = write_lines(tmp_dir, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = ndjson.read_lines(spark, path)
        assert got.rdd.getNumPartitions() > 10
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expect = {i + 1: v for i, v in enumerate(lines) if v}
    assert {r.line: r.value for r in rows} == expect


def test_builder_documents_and_first_error(spark, tmp_dir):
    lines = ['{"title": "Oak Bridge", "tag": "wood", "count": 42}',
             '{"title": "Iron Gate", "tag": "metal", "count": 7, "bogus": 1}']
    v = _validated(spark, tmp_dir, lines, F1)
    fe = validate.first_error(v, F1).collect()
    assert fe[0].line == 2 and fe[0].message == "Line 2: unknown field 'bogus'"
    docs = validate.typed_documents(v, F1).collect()
    assert [(d.doc_id, d.title, d.tag, d["count"]) for d in docs] == [(1, "Oak Bridge", "wood", 42)]


def test_type_mismatch_long(spark, tmp_dir):
    v = _validated(spark, tmp_dir, ['{"count": "a dozen"}'], F1)
    msg = validate.first_error(v, F1).collect()[0].message
    assert msg == "Line 1: field 'count' expected long but got String value 'a dozen'"


def test_null_field(spark, tmp_dir):
    v = _validated(spark, tmp_dir, ["{}", "{}", '{"title": null}'], F1)
    assert validate.first_error(v, F1).collect()[0].message == "Line 3: field 'title' is null"


def test_coercions(spark, tmp_dir):
    cases = [
        ('{"k": "kettle"}', "k", "kettle"), ('{"t": "calm sea"}', "t", "calm sea"),
        ('{"l": 42}', "l", 42), ('{"l": "15"}', "l", 15), ('{"l": " 15 "}', "l", 15), ('{"l": "+15"}', "l", 15),
        ('{"l": 3.9}', "l", 3), ('{"l": 1e30}', "l", 9223372036854775807), ('{"l": -1e30}', "l", -9223372036854775808),
        ('{"d": 3.14}', "d", 3.14), ('{"d": "2.5"}', "d", 2.5), ('{"d": "NaN"}', "d", "nan"), ('{"d": "1d"}', "d", 1.0),
        ('{"b": true}', "b", True), ('{"b": false}', "b", False), ('{"b": "TRUE"}', "b", True), ('{"b": " false "}', "b", False),
    ]
    v = _validated(spark, tmp_dir, [c[0] for c in cases], ALL)
    rows = {r.line: r for r in validate.values(v, ALL).select("line", "status", "doc.*").collect()}
    for i, (_, f, want) in enumerate(cases, start=1):
        assert rows[i].status == "OK", cases[i - 1]
        got = rows[i][f]
        if want == "nan":
            assert got != got
        else:
            assert got == want, cases[i - 1]


def test_mismatches(spark, tmp_dir):
    cases = [
        ('{"k": 123}', "Line 1: field 'k' expected keyword (string) but got Integer value '123'"),
        ('{"l": "15.5"}', "Line 2: field 'l' expected long but got String value '15.5'"),
        ('{"b": "maybe"}', "Line 3: field 'b' expected boolean but got String value 'maybe'"),
        ('{"b": "yes"}', "Line 4: field 'b' expected boolean but got String value 'yes'"),
        ('{"b": 1}', "Line 5: field 'b' expected boolean but got Integer value '1'"),
        ('{"d": "inf"}', "Line 6: field 'd' expected double but got String value 'inf'"),
        ('{"t": 2.0}', "Line 7: field 't' expected text (string) but got Double value '2.0'"),
        ('{"l": true}', "Line 8: field 'l' expected long but got Boolean value 'true'"),
        ('{"k": 12345678901}', "Line 9: field 'k' expected keyword (string) but got Long value '12345678901'"),
    ]
    v = _validated(spark, tmp_dir, [c[0] for c in cases], ALL)
    got = {r.line: r.message for r in validate.errors(v, ALL).collect()}
    assert got == {i: m for i, (_, m) in enumerate(cases, start=1)}
    arr = _validated(spark, tmp_dir, ['{"k": [1, 2]}'], ALL)
    e = validate.errors(arr, ALL).collect()[0]
    assert e.kind == "TYPE_MISMATCH" and "ArrayList" in e.message


def test_first_error_is_first_key_in_document_order(spark, tmp_dir):
    v = _validated(spark, tmp_dir, ['{"l": "x", "zz": 1, "k": 5}'], ALL)
    assert validate.first_error(v, ALL).collect()[0].message.startswith("Line 1: field 'l'")


def test_malformed_and_edge_documents(spark, tmp_dir):
    lines = ['{"k": "a"} trailing', "[]", "null", "not json", "{}", '{"k": "a", "k": "b"}']
    v = _validated(spark, tmp_dir, lines, ALL)
    rows = {r.line: r for r in validate.values(v, ALL).select("line", "status", "malformed", "doc.*").collect()}
    assert rows[1].malformed == "TRAILING_CONTENT"
    assert rows[2].malformed == "NOT_AN_OBJECT" and rows[3].malformed == "NOT_AN_OBJECT"
    assert rows[4].malformed == "INVALID_JSON"
    assert rows[5].status == "OK"
    assert rows[6].status == "OK" and rows[6].k == "b"  # last value of a repeated key
    counts = validate.doc_count(v).collect()[0]
    assert counts.doc_count == 6 and counts.failed_lines == 4


def test_json_fields_classes(spark, tmp_dir):
    path = write_lines(tmp_dir, ['{"a": 1, "b": 2.0, "c": "x", "d": null, "e": true, "f": 3000000000}'])
    rows = ndjson.json_fields(ndjson.parse(ndjson.read_lines(spark, path))).orderBy("position").collect()
    assert [(r.field, r.json_type, r.value) for r in rows] == [
        ("a", "Integer", "1"), ("b", "Double", "2.0"), ("c", "String", "x"), ("d", None, None),
        ("e", "Boolean", "true"), ("f", "Long", "3000000000")]


def test_optional_keyword_byte_limit(spark, tmp_dir):
    big = "é" * 20000  # 40,000 UTF-8 bytes
    lines = [f'{{"k": "{big}"}}', '{"k": "ok"}']
    off = _validated(spark, tmp_dir, lines, ALL)
    assert [r.status for r in off.orderBy("line").collect()] == ["OK", "OK"]
    path = write_lines(tmp_dir, lines, "big.ndjson")
    on = validate.validate(ndjson.parse(ndjson.read_lines(spark, path)), ALL,
                           keyword_byte_limit=validate.MAX_TERM_BYTES)
    e = validate.errors(on, ALL).collect()
    assert len(e) == 1 and e[0].kind == "IMMENSE_TERM" and "40000 bytes" in e[0].message


def test_line_terminators(spark, tmp_dir):
    path = f"{tmp_dir}/crlf.ndjson"
    with open(path, "wb") as f:
        f.write(b'{"title": "a"}\r\n\r\n{"title": "b"}\r{"title": "c"}\n')
    got = sorted((r.line, r.value) for r in ndjson.read_lines(spark, path).collect())
    assert got == [(1, '{"title": "a"}'), (3, '{"title": "b"}'), (4, '{"title": "c"}')]


def test_lines_numbered_across_files_in_path_order(spark, tmp_dir):
    write_lines(tmp_dir, ['{"title": "a"}', '{"title": "b"}'], "part-0.ndjson")
    write_lines(tmp_dir, ['', '{"title": "c"}'], "part-1.ndjson")
    got = sorted((r.line, r.value) for r in ndjson.read_lines(spark, tmp_dir).collect())
    assert got == [(1, '{"title": "a"}'), (2, '{"title": "b"}'), (4, '{"title": "c"}')]


def test_double_strings_follow_parse_double(spark, tmp_dir):
    ok = {"1e400": float("inf"), "0x1.8p1": 3.0, "1f": 1.0, "1.5F": 1.5, "-Infinity": float("-inf"),
          ".5": 0.5, "5.": 5.0, "1e-400": 0.0, " 2 ": 2.0}
    bad = ["inf", "nan", "1_000", "Infinityd", "0x10", "1e"]
    lines = [f'{{"d": "{s}"}}' for s in list(ok) + bad] + ['{"d": "+NaN"}']
    v = _validated(spark, tmp_dir, lines, ALL)
    rows = {r.line: r for r in validate.values(v, ALL).select("line", "status", "doc.*").collect()}
    for i, s in enumerate(ok, start=1):
        assert rows[i].status == "OK" and rows[i].d == ok[s], s
    for j, s in enumerate(bad, start=len(ok) + 1):
        assert rows[j].status == "INVALID", s
    nan = rows[len(lines)]
    assert nan.status == "OK" and nan.d != nan.d


def test_big_integers_keep_low_64_bits(spark, tmp_dir):
    lines = ['{"l": 18446744073709551617}', '{"l": 9223372036854775808}',
             '{"l": 1' + "0" * 39 + '}', '{"l": -9223372036854775809}']
    v = _validated(spark, tmp_dir, lines, ALL)
    got = {r.line: r.l for r in validate.values(v, ALL).select("line", "doc.*").collect()}
    assert got == {1: 1, 2: -9223372036854775808, 3: 9223372036854775807, 4: 9223372036854775807}


def test_gzip_and_plain_files_numbered_in_path_order(spark, tmp_dir):
    import gzip
    with gzip.open(f"{tmp_dir}/a.ndjson.gz", "wt", encoding="utf-8") as f:
        f.write('{"title": "a"}\n\n{"title": "b"}\n')
    write_lines(tmp_dir, ['{"title": "c"}'], "b.ndjson")
    got = sorted((r.line, r.value) for r in ndjson.read_lines(spark, tmp_dir).collect())
    assert got == [(1, '{"title": "a"}'), (3, '{"title": "b"}'), (4, '{"title": "c"}')]


def test_json_fields_repeated_keys_and_collections(spark, tmp_dir):
    path = write_lines(tmp_dir, ['{"a": 1, "b": [1, 2], "a": "x", "c": {"d": 1}}'], "dup.ndjson")
    rows = ndjson.json_fields(ndjson.parse(ndjson.read_lines(spark, path))).orderBy("position").collect()
    assert [(r.position, r.field, r.json_type) for r in rows] == [
        (0, "a", "String"), (1, "b", "ArrayList"), (2, "c", "LinkedHashMap")]
    assert rows[0].value == "x"  # a repeated key keeps its first place and its last value


def test_two_documents_on_a_line_are_refused(spark, tmp_dir):
    lines = ['{"k": "a"} {"k": "b"}', '{"k": "a"},{"k": "b"}', '  {"k": "c"}  ', '{"k": "d"}]', '{"k": ["x"]} [']
    v = _validated(spark, tmp_dir, lines, ALL)
    got = {r.line: r.malformed for r in validate.values(v, ALL).collect()}
    assert got == {1: "TRAILING_CONTENT", 2: "TRAILING_CONTENT", 3: None, 4: "TRAILING_CONTENT", 5: "TRAILING_CONTENT"}


def test_field_names_that_look_like_internal_columns(spark, tmp_dir):
    """NDJSON to a published and loaded version whose fields are called like the machinery's own columns."""
    from lexidx.operators import artifact, index, search, versioning
    fields = fields_of([(n, "keyword") for n in ("status", "line", "value", "keys", "j", "malformed")]
                       + [("doc_id", "long"), ("field", "text"), ("term", "double")])
    lines = ['{"status": "INVALID", "line": "7", "value": "v", "keys": "k", "j": "{}", "malformed": "yes", "doc_id": 70, '
             '"field": "blue sky", "term": 1.5}', '{"status": "OK"}']
    src = write_lines(tmp_dir, lines)
    log = versioning.build_version(spark, src, fields, f"{tmp_dir}/st", "odd", 1, version_id="u")
    built = [r for r in log.collect() if r.kind == "BUILT"]
    assert [r.doc_count for r in built] == [2]
    t = index.read(spark, artifact.data_path(spark, f"{tmp_dir}/st", "odd", 1))
    row = {r.doc_id: r for r in t.stored.collect()}[1]
    assert (row.status, row["line"], row.value, row["keys"], row.j, row.malformed) == ("INVALID", "7", "v", "k", "{}", "yes")
    assert row["doc_id#field"] == 70 and row.field == "blue sky" and row.term == 1.5
    assert [r.doc_id for r in search.term_lookup(t.postings, "field", "sky").collect()] == [1]
    assert [r.doc_id for r in search.numeric_range(t.long_points, "doc_id", 70, 70).collect()] == [1]
    bad = _validated(spark, tmp_dir, ['{"status": 5, "value": null}'], fields)
    assert {r.message for r in validate.errors(bad, fields).collect()} == {
        "Line 1: field 'status' expected keyword (string) but got Integer value '5'", "Line 1: field 'value' is null"}


def test_validation_scans_the_text_without_joining_itself(spark, tmp_dir):
    v = _validated(spark, tmp_dir, ['{"k": 5}'], ALL)
    plan = validate.coerced(v, ALL[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 3  # offsets of blocks and files only
    assert [(r.value, r.message is not None) for r in validate.coerced(v, ALL[0]).collect()] == [(None, True)]

"""Records are linked, digests hold, files parse back record by record."""

import glob
import hashlib
import os
import re
import time

from pyspark.sql import functions as F

from lexidx.llm import queries, warc
from tests.llm.helpers import SF_SMALL

KIND = "page_id long, url string, html string"


def sha(s):
    return "sha256:" + hashlib.sha256(s.encode()).hexdigest()


def test_whole_table_is_linked_and_digested(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    out = queries.op6_warc(spark, SF_SMALL).collect()
    assert len(out) == 2 * len(pages) and len({r.record_id for r in out}) == len(out)
    for r in out:
        assert r.source_digest == sha(pages[r.page_id].html) and r.block_digest == sha(r.block)
        assert r.content_length == len(r.block.encode()) and r.target_uri == pages[r.page_id].url
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and f"WARC-Record-ID: {r.refers_to}" in r.source_headers
        if r.record_type == "metadata":
            assert f"source-record-id: {r.refers_to}\r\n" in r.block and f"source-payload-digest: {r.source_digest}\r\n" in r.block
    assert {r.record_type for r in out} == {"metadata", "conversion"}


def test_plain_text_and_edge_rows(spark):
    html = ("<html><head><title>T</title><style>x{}</style></head><body><p>One&nbsp;&amp; two</p><!-- no --><script>var a='<p>';</script>"
            "<div>3 &lt; 4 <b>bold</b><br/>next</div><a href=\"/u\">l</a></body></html>")
    rows = [(1, "http://a\r\nX: y", html), (2, None, None), (3, "http://c", ""), (3, "http://c", "")]
    df = spark.createDataFrame(rows, KIND).withColumn("text", F.lit(1)).withColumn("block", F.lit(1))
    out = warc.derivatives(warc.responses(df)).collect()
    text = {r.page_id: r.block for r in out if r.record_type == "conversion"}
    assert text[1] == "One & two\n3 < 4 bold\nnext\nl" and text[2] == text[3] == ""
    assert all("source-header: \r\n" not in r.block and "\r\nX: y" not in r.headers for r in out)
    assert any("outlink: /u\r\n" in r.block for r in out) and len(out) == 8
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_files_parse_back(spark, tmp_dir):
    df = spark.createDataFrame([(1, "http://a", "<p>a</p>\r\n\r\nWARC/1.1 é"), (2, "http://b", "")], KIND)
    source = warc.responses(df)
    path = os.path.join(tmp_dir, "warc")
    warc.write_records(source.select("headers", "block").unionByName(warc.derivatives(source).select("headers", "block")), path)
    seen = []
    for f in glob.glob(path + "/part-*"):
        with open(f, "rb") as fh:
            data = fh.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            block, data = rest[:n], rest[n:]
            assert data.startswith(b"\r\n\r\n") and fields[b"WARC-Block-Digest"].decode() == "sha256:" + hashlib.sha256(block).hexdigest()
            data = data[4:]
            seen.append(fields[b"WARC-Type"])
    assert sorted(seen) == [b"conversion"] * 2 + [b"metadata"] * 2 + [b"response"] * 2


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(pages)], KIND)
    return {r.page_id: r.block for r in warc.derivatives(warc.responses(df)).collect() if r.record_type == "conversion"}


AWKWARD = ["&copy;&#169;&#xA9; &#x1F600; &middot; &amp;lt; &nosuch; &; & x &#0; &#xD800; &#150; &#129; &#0000000065; &#99999999; &copy", "a&", "<p>open <script>no end",
           "<p>open <!-- no end", "tail <b", "<head>h</head>t", "<script>'</head>'</script><b>x</b>", "<p>&lt;b&gt;&Tab;&NewLine;y", "&NotEqualTilde;"]


def test_references_and_malformed_pages(spark):
    got = texts(spark, AWKWARD)
    assert got[0] == "©©© 😀 · &lt; &nosuch; &; & x � � – � A &#99999999; &copy"
    assert [got[i] for i in range(1, 9)] == ["a&", "open", "open", "tail", "t", "x", "<b>\ny", "≂̸"]


def test_no_reference_stays_in_the_tables_pages(spark):
    rows = [r for r in queries.op6_warc(spark, SF_SMALL).where("record_type = 'conversion'").collect()]
    assert any("©" in r.block and "·" in r.block for r in rows)
    assert not any(re.search(r"&(#\d+|[A-Za-z]+\d*);", r.block) for r in rows)


def test_links_in_all_forms(spark):
    page = "<a href='/q'>1</a><A x=1 HREF=/un class=x>2</a><a class=b\nhref = \"/w?a=1\">3</a><a data-href='/no'>4</a><a href=\"/q\"><a href=''>"
    df = spark.createDataFrame([(1, "http://x", page)], KIND)
    (meta,) = warc.derivatives(warc.responses(df)).where("record_type = 'metadata'").collect()
    assert [x for x in meta.block.split("\r\n") if x.startswith("outlink")] == ["outlink: /q", "outlink: /un", "outlink: /w?a=1", "outlink: "]


def test_sql_agrees_on_awkward_pages(spark):
    import duckdb

    from lexidx.llm import sql
    pages = [*AWKWARD, "<a href='/q'>1</a><a href=/u>", None, "", "<div>x\t\ty  z\r\n</div>"]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(pages)], KIND)
    out = warc.derivatives(warc.responses(df))
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    expected = con.sql(sql.WARC)
    names = sorted(out.columns)
    assert names == sorted(expected.columns)
    spot = [expected.columns.index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == sorted(tuple(r[i] for i in spot) for r in expected.fetchall())


def test_long_malformed_pages_take_linear_time(spark):
    n = 100_000
    pages = ["<script " * n, "<p " * n, "<!--" * n, "<a href" * n, "&" * n + ";", "<script>" * n, "<head>" * n, '<a href="' * n, "<template><" * n]
    began = time.time()
    assert len(texts(spark, pages)) == len(pages)
    assert time.time() - began < 60

"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Every page is taken as a ``response`` record: an HTTP answer whose payload is the
page. From it come two records: ``metadata`` (application/warc-fields: the
source's headers, digests, counts and outgoing links) and ``conversion`` (the page
as plain text). Both name the response in WARC-Refers-To and carry its target
URI and date; record ids are derived from the content, so a rerun or a retried
task gives the same ids.

Character references that end in a semicolon are resolved, named and numeric alike (one pass:
what they give is not read again); outgoing links may be quoted either way or not at all.

Defined cases: a null page counts as empty, a null URI gives an empty
WARC-Target-URI, line ends in one are left out; very long pages are converted whole; an element, comment
or tag that does not end reaches to the end of the page, so malformed pages take linear time; unknown references
stay as they are, references to what is no character give U+FFFD; repeated rows give
records with the same ids; an empty table gives none; other columns are ignored.
Everything is a narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
VERSION = "WARC/1.1"

# Elements whose content is no text (raw ones first, since a head may hold them), and tags that break lines.
RAW = ("script", "style", "noscript", "template")
BREAKING = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre|hr|title|nav|main|aside"
# Named characters: the standard table, with a blank for the non-breaking one; the frequent names are tried first.
NAMED = {**{n[:-1]: c for n, c in html5.items() if n.endswith(";")}, "nbsp": " "}
FREQUENT = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "reg", "trade", "middot", "bull", "ndash", "mdash", "hellip",
            "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo", "euro", "times")
LONGEST_NAME = max(map(len, NAMED))
# Numbers 128 to 159 name what the Windows code page has there.
WINDOWS = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}

_S = r"[ \t\r\n\f]"


def _element(name: str) -> str:
    return rf"{name}(?:{_S}[^>]*)?(?:>|\z).*?(?:</{name}{_S}*>|\z)"


# One pattern text for the operator and its SQL.
NO_TEXT = rf"(?is)<(?:!--.*?(?:-->|\z)|{'|'.join(map(_element, RAW))})"
HEAD = rf"(?is)<{_element('head')}"
BREAK = rf"(?i)</?(?:{BREAKING})(?:{_S}[^>]*)?/?(?:>|\z)"
TAG = r"<[/!?A-Za-z][^>]*(?:>|\z)"
BLANKS = ("\t", "\r", "\f")
LINES = r"\n[ \n]+"
LINK = rf"(?i)<a{_S}(?:[^<>]*?{_S})?href{_S}*={_S}*(\"[^\"\r\n]*\"|'[^'\r\n]*'|[^ \t\r\n\f\"'<>]+)"


def with_text(pages: DataFrame, html: str, out: str) -> DataFrame:
    """Add ``out``, the visible text of ``html``: hidden elements and comments dropped, blocks on lines of their own, blanks squeezed.

    Each step is a column, so that what is read several times is computed once.
    """
    c = F.col(html)
    for pattern, by in ((NO_TEXT, ""), (HEAD, ""), (BREAK, "\n"), (TAG, "")):
        c = F.regexp_replace(c, pattern, by)
    read = pages.withColumn("_bare", c).withColumn("_read", resolved(F.col("_bare")))
    c = F.col("_read")
    for blank in BLANKS:
        c = F.replace(c, F.lit(blank), F.lit(" "))
    single = read.withColumn("_single", c)
    c = F.when(F.contains("_single", F.lit("  ")), F.regexp_replace("_single", " {2,}", " ")).otherwise(F.col("_single"))
    c = F.regexp_replace(F.replace(c, F.lit(" \n"), F.lit("\n")), LINES, "\n")
    return single.withColumn(out, F.trim(F.btrim(c, F.lit("\n")))).drop("_bare", "_read", "_single")


def resolved(text: Column) -> Column:
    """Character references replaced by their characters, from left to right, once."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])

    def character(name: Column) -> Column:
        number = (F.when(name.rlike("^#0*[0-9]{1,7}$"), F.substring(name, F.lit(2), F.length(name)).cast("long"))
                  .when(name.rlike("^#[xX]0*[0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("long")))
        no_character = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        numeric = (F.when(no_character, F.lit("\ufffd"))
                   .when(number.between(128, 159), F.coalesce(F.try_element_at(windows, number.cast("int")), F.lit("\ufffd")))
                   .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        known = F.when(name == FREQUENT[0], NAMED[FREQUENT[0]])
        for n in FREQUENT[1:]:
            known = known.when(name == n, NAMED[n])
        return (known.when(name.startswith("#"), numeric)
                .when(F.length(name) <= LONGEST_NAME, F.try_element_at(names, name)))

    # What stands between an ampersand and the first semicolon after it may be a name.
    pieces = F.transform(F.split(text, "&"), lambda p: F.struct(p.alias("p"), F.when(F.instr(p, ";") > 0, F.substring_index(p, ";", 1)).alias("name")))
    read = F.transform(pieces, lambda x, i: F.when(i == 0, F.struct(x["p"].alias("p"), F.lit(0).alias("cut"), F.lit("").alias("by"))).otherwise(
        F.struct(x["p"].alias("p"), (F.length(x["name"]) + 1).alias("cut"), character(x["name"]).alias("by"))))
    whole = F.array_join(F.transform(read, lambda x: F.when(x["by"].isNull(), F.concat(F.lit("&"), x["p"])).otherwise(
        F.concat(x["by"], F.substring(x["p"], x["cut"] + 1, F.length(x["p"]))))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def out_links(html: Column) -> Column:
    """Targets of the page's links, without their quotes, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(LINK), 1)
    return F.array_distinct(F.transform(found, lambda u: F.when(u.startswith('"') | u.startswith("'"), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u)))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in pairs for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, record_id, record_type, target_uri, headers, block, payload, payload_digest): pages as response records."""
    # A line end in a URI must not start a header of its own.
    src = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", "").alias("target_uri"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    out = src.withColumn("payload_digest", _digest(F.col("payload"))).withColumn("block", F.concat(http, F.col("payload")))
    out = out.withColumn("record_id", _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                            F.col("target_uri"), F.col("payload_digest")))
    headers = F.concat(F.lit(VERSION + CRLF), _fields(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.lit(date)), ("WARC-Block-Digest", _digest(F.col("block"))), ("WARC-Payload-Digest", F.col("payload_digest")),
        ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.octet_length("block").cast("string"))))
    return out.select("page_id", "record_id", F.lit("response").alias("record_type"), "target_uri", headers.alias("headers"),
                      "block", "payload", "payload_digest")


def derivatives(source: DataFrame, date: str = DATE) -> DataFrame:
    """Two records for each response: (page_id, record_type, record_id, refers_to, target_uri, source_digest, headers, block, ...)."""
    text = with_text(source, "payload", "text")
    text = text.withColumn("text_digest", _digest(F.col("text")))  # the digest of the conversion's block as well
    links = out_links(F.col("payload"))
    meta = F.concat(
        _fields(("source-record-id", F.col("record_id")), ("source-payload-digest", F.col("payload_digest")),
                ("source-headers-digest", _digest(F.col("headers"))), ("text-digest", F.col("text_digest")),
                ("text-length", F.octet_length("text").cast("string"))),
        F.array_join(F.transform(F.filter(F.split("headers", CRLF), lambda h: h != ""),
                                 lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF))), ""),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("meta").alias("block"),
                 _digest(F.col("meta")).alias("block_digest")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"),
                 F.col("text_digest").alias("block_digest")))
    out = text.withColumn("meta", meta).select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", F.col("payload_digest").alias("source_digest"),
        F.col("headers").alias("source_headers"), F.inline(kinds))
    out = out.withColumn(
        "record_id", _uuid(F.col("record_type"), F.col("refers_to"), F.col("block_digest")))
    headers = F.concat(F.lit(VERSION + CRLF), _fields(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.lit(date)), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.octet_length("block").cast("string"))))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "source_headers",
                      "content_type", "block_digest", F.octet_length("block").cast("long").alias("content_length"),
                      headers.alias("headers"), "block")


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files: headers, a blank line, the block, two line ends; record after record.

    ``lineSep`` is the end of a record, so Spark's text writer writes the format as it is.
    """
    (records.select(F.concat("headers", F.lit(CRLF), "block").alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path))

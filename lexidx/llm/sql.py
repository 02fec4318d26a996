"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from lexidx.llm import chat, runs, spelling, substrings, warc

TRIAL = "</s>[INST] ok [/INST]"
_ESCAPES = r"[<\[]\\*" + chat.CONTROL_TAIL
_BLOCK = len(chat.BEGIN + chat.ROLE + chat.ROLE_END + chat.END)

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRIAL}' UNION ALL SELECT -7, 1, 'assistant', '{TRIAL}'),
placed AS (
  SELECT *, row_number() OVER w AS i, coalesce(role <> lag(role) OVER w, true) AS heads
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPES}'))
       + CASE WHEN heads THEN {_BLOCK} + length(role) + len(regexp_extract_all(role, '{_ESCAPES}')) ELSE {len(chat.AND)} END AS chars
  FROM placed),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole"""


def _uuid(*parts: str) -> str:
    h = "md5(" + " || chr(10) || ".join(parts) + ")"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


def _fields(*pairs: tuple[str, str]) -> str:
    return " || ".join(f"'{name}: ' || {value} || E'\\r\\n'" for name, value in pairs)


def _digest(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


REPLACED = "\ufffd"
# After the first piece, what stands before a semicolon may name a character.
NAMES = ", ".join(f"({_quoted(n)}, {_quoted(c)})" for n, c in warc.NAMED.items())
WINDOWS = "[" + ", ".join(_quoted(warc.WINDOWS.get(i, "\ufffd")) for i in range(128, 160)) + "]"


def _no_markup(x: str) -> str:
    for pattern, by in ((warc.NO_TEXT, "''"), (warc.HEAD, "''"), (warc.BREAK, "chr(10)"), (warc.TAG, "''")):
        x = f"regexp_replace({x}, {_quoted(pattern)}, {by}, 'g')"
    return x


def _squeezed(x: str) -> str:
    for blank in warc.BLANKS:
        x = f"replace({x}, chr({ord(blank)}), ' ')"
    x = f"replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), ' ' || chr(10), chr(10))"
    x = f"regexp_replace({x}, {_quoted(warc.LINES)}, chr(10), 'g')"
    return rf"trim(regexp_replace({x}, '^\n|\n$', '', 'g'), ' ')"


WARC = rf"""
WITH src AS (
  SELECT row_number() OVER () AS i, page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') AS target_uri, coalesce(html, '') AS payload FROM pages),
names(n, c) AS (VALUES {NAMES}),
cut AS (SELECT i, string_split({_no_markup("payload")}, '&') AS pieces FROM src),
piece AS (SELECT i, generate_subscripts(pieces, 1) AS k, unnest(pieces) AS p FROM cut),
maybe AS (SELECT i, k, p, CASE WHEN k > 1 AND contains(p, ';') THEN split_part(p, ';', 1) END AS n FROM piece),
valued AS (
  SELECT *, CASE WHEN regexp_full_match(n, '#0*[0-9]{{1,7}}') THEN CAST(n[2:] AS BIGINT)
                 WHEN regexp_full_match(n, '#[xX]0*[0-9a-fA-F]{{1,6}}') THEN CAST('0x' || n[3:] AS BIGINT) END AS v FROM maybe),
read AS (
  SELECT i, k, p, n, coalesce(c, CASE WHEN v = 0 OR v > 1114111 OR v BETWEEN 55296 AND 57343 THEN '{REPLACED}'
                                      WHEN v BETWEEN 128 AND 159 THEN {WINDOWS}[v - 127] WHEN v IS NOT NULL THEN chr(CAST(v AS INTEGER)) END) AS c
  FROM valued LEFT JOIN names USING (n)),
plain AS (
  SELECT i, string_agg(CASE WHEN k = 1 THEN p WHEN c IS NULL THEN '&' || p ELSE c || substr(p, length(n) + 2) END, '' ORDER BY k) AS t FROM read GROUP BY i),
answer AS (
  SELECT *, {_digest('payload')} AS source_digest, E'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: '
         || strlen(payload) || E'\r\n\r\n' || payload AS http, {_squeezed('t')} AS text FROM src JOIN plain USING (i)),
named AS (
  SELECT *, {_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "source_digest")} AS refers_to FROM answer),
headed AS (
  SELECT *, E'WARC/1.1\r\n' || {_fields(
      ("WARC-Type", "'response'"), ("WARC-Record-ID", "refers_to"), ("WARC-Target-URI", "target_uri"),
      ("WARC-Date", f"'{warc.DATE}'"), ("WARC-Block-Digest", _digest("http")), ("WARC-Payload-Digest", "source_digest"),
      ("Content-Type", "'application/http;msgtype=response'"), ("Content-Length", "strlen(http)"))} AS source_headers,
      list_transform(regexp_extract_all(payload, {_quoted(warc.LINK)}, 1),
                     lambda u: CASE WHEN u[1] IN ('"', '''') THEN u[2:-2] ELSE u END) AS links FROM named),
both_kinds AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM headed
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', {_fields(
      ("source-record-id", "refers_to"), ("source-payload-digest", "source_digest"), ("source-headers-digest", _digest("source_headers")),
      ("text-digest", _digest("text")), ("text-length", "strlen(text)"))}
      || 'source-header: ' || replace(rtrim(source_headers, E'\r\n'), E'\r\n', E'\r\nsource-header: ') || E'\r\n'
      || coalesce(list_aggregate(list_transform(list_filter(links, lambda x, i: list_position(links, x) = i),
                                                lambda u: 'outlink: ' || u || E'\r\n'), 'string_agg', ''), '')
  FROM headed),
done AS (
  SELECT *, {_digest('block')} AS block_digest FROM both_kinds),
ided AS (
  SELECT *, {_uuid("record_type", "refers_to", "block_digest")} AS record_id FROM done)
SELECT page_id, record_type, record_id, refers_to, target_uri, source_digest, source_headers, content_type, block_digest,
       CAST(strlen(block) AS BIGINT) AS content_length,
       E'WARC/1.1\r\n' || {_fields(
      ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
      ("WARC-Target-URI", "target_uri"), ("WARC-Date", f"'{warc.DATE}'"), ("WARC-Block-Digest", "block_digest"),
      ("Content-Type", "content_type"), ("Content-Length", "strlen(block)"))} AS headers,
       block
FROM ided"""


# ---- repeated substrings, runs, spelling variants -----------------------

CHUNK = 256  # a substring is found by counting from the start

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
c AS (SELECT r, doc_id, c, substr(h, 2 * c + 1, 2 * ({CHUNK} + {substrings.LENGTH} - 1)) AS h
      FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - {substrings.LENGTH} + 1, {CHUNK})) AS c FROM d WHERE doc_id IS NOT NULL)),
g AS (SELECT r, doc_id, c + i AS i, substr(h, 2 * i + 1, 2 * {substrings.LENGTH}) AS w
      FROM (SELECT r, doc_id, c, h, unnest(range(0, length(h) // 2 - {substrings.LENGTH} + 1)) AS i FROM c)),
least AS (SELECT w, min(doc_id) AS least FROM g GROUP BY w HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i FROM g JOIN least USING (w) WHERE doc_id > least)),
numbered AS (SELECT r, i, count(*) FILTER (WHERE before IS NULL OR i > before + {substrings.LENGTH}) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, min(i) AS a, max(i) + {substrings.LENGTH} AS b FROM numbered GROUP BY r, k),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM span),
cut AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept, max(b) AS last
        FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""


CRC_TABLE = ("list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), "
             "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n))")


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes, one byte after the other; ``crc`` holds the table, made by the rule."""
    byte = f"CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT)"
    steps = f"list_transform(range(0, length(hex({text})) // 2), lambda i: {byte})"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


RUNS = rf"""
WITH crc AS (SELECT {CRC_TABLE} AS t),
read AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
planned AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS loops FROM read),
placed AS (SELECT *, CASE WHEN loops THEN g % n END AS a FROM planned),
looped AS (SELECT r, doc_id, n, CASE WHEN loops THEN list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1])
                  ELSE words END AS words FROM placed),
word AS (SELECT r, n, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS w FROM looped),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * {runs.TIMES} <= x.n),
island AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM same),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest({runs.LEAST}, {runs.TIMES} * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT * FROM run x WHERE NOT EXISTS (
           SELECT 1 FROM run y WHERE y.r = x.r AND (y.l * x.q > x.l * y.q OR y.l * x.q = x.l * y.q AND (y.s, y.q) < (x.s, x.q)))),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(s + q, s + l)) AS i FROM run)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM looped LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

SPELLING = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
said AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS word FROM documents),
per_doc AS (SELECT doc_id, word, count(*) AS n FROM said GROUP BY doc_id, word),
marked AS (SELECT word, n, {_crc32("CAST(doc_id AS VARCHAR) || ':' || word")} AS h FROM per_doc, crc),
typed AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(word, 1, CAST(h % length(word) AS BIGINT)) || substr(word, CAST(h % length(word) AS BIGINT) + 2) ELSE word END AS word FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed GROUP BY word HAVING length(word) >= {spelling.LEAST_LENGTH} AND sum(n) >= {spelling.LEAST_COUNT}),
less AS (SELECT word, word AS key FROM words
         UNION SELECT word, substr(word, 1, k - 1) || substr(word, k + 1) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (SELECT DISTINCT x.word, y.word AS other FROM less x JOIN less y USING (key) WHERE x.word <> y.word AND (
    length(x.word) = length(y.word) AND len(list_filter(range(1, length(x.word) + 1), lambda i: substr(x.word, i, 1) <> substr(y.word, i, 1))) = 1
    OR abs(length(x.word) - length(y.word)) = 1)),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                  row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS k
           FROM near JOIN words o ON o.word = other),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
           FROM words w LEFT JOIN ranked ON ranked.word = w.word AND k = 1),
up AS (SELECT word, word AS root FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL),
top AS (SELECT up.word, up.root FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, top.root, f.n, f.n_near, f.form_n FROM formed f JOIN top USING (word)"""

ORACLE_SQL = {"op6_warc": WARC, "op9_chat": CHAT, "op11_substrings": SUBSTRINGS, "op12_runs": RUNS, "op13_spelling": SPELLING}

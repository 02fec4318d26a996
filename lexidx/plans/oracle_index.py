"""DuckDB SQL that recomputes each registered query from the raw tables.

These strings are the correctness oracle the driver runs side by side with
the Spark queries; they share only the fixed parameters with the library.
"""

from __future__ import annotations

from lexidx.functions.analyzer import MAX_TOKEN_LENGTH
from lexidx.operators.blockmax import BLOCK
from lexidx.plans import index_queries as iq


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The same tokenizer for RE2, which has no class intersection: surround each
# Han/Hiragana character with spaces, then match runs of the plain class.
ORACLE_SPLIT = r"([\p{Han}\p{Hiragana}])"
ORACLE_WORD_PATTERN = r"[\p{L}\p{M}\p{Nd}_]+(?:['’.·:][\p{L}\p{M}\p{Nd}_]+|[.,']\p{Nd}+)*"


def tokens_sql(col: str, pattern: str = ORACLE_WORD_PATTERN) -> str:
    m = MAX_TOKEN_LENGTH
    split = f"regexp_replace(lower({col}), {_q(ORACLE_SPLIT)}, ' \\1 ', 'g')"
    return (f"flatten(list_transform(regexp_extract_all({split}, {_q(pattern)}), "
            f"lambda t: CASE WHEN length(t) <= {m} THEN [t] ELSE list_transform("
            f"range(0, (length(t) - 1) // {m} + 1), lambda i: substr(t, i * {m} + 1, {m})) END))")


TOK = f"""toks AS (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, CAST(generate_subscripts(tk, 1) - 1 AS INTEGER) AS position,
               unnest(tk) AS term FROM toks),
lens AS (SELECT doc_id, CAST(len(tk) AS INTEGER) AS dl FROM toks),
post AS (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf,
                string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions
         FROM tok GROUP BY doc_id, term),
fstat AS (SELECT count(*) AS n, sum(dl) AS sum_length, sum(dl) / count(*) AS avgdl FROM lens WHERE dl > 0)"""

PART = """pidx AS (SELECT p_partkey AS doc_id, p_name AS title, p_brand AS tag,
                 CAST(p_size AS BIGINT) AS count, p_retailprice AS price,
                 (p_size % 2 = 0) AS in_stock FROM part)"""


def _values(terms: list[str]) -> str:
    counts: dict[str, int] = {}
    for t in terms:
        counts[t] = counts.get(t, 0) + 1
    return ", ".join(f"({_q(t)}, {c})" for t, c in sorted(counts.items()))


BM25 = f"""q(term, qcount) AS (VALUES {_values(iq.BM25_TERMS)}),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
scores AS (
  SELECT p.doc_id, sum(q.qcount * ln(1 + (f.n - d.df + 0.5) / (d.df + 0.5)) * p.tf
         / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / f.avgdl))) AS score
  FROM post p JOIN q USING (term) JOIN dfs d USING (term) JOIN lens l USING (doc_id), fstat f
  GROUP BY p.doc_id),
top AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores ORDER BY score DESC, doc_id LIMIT {iq.BM25_K})"""

INDEX_SQL = {
    "analyze_text": f"WITH {TOK} SELECT doc_id, position, term FROM tok",
    "text_postings": f"""WITH {TOK}
        SELECT 'text' AS field, term, doc_id, tf, positions, dl FROM post JOIN lens USING (doc_id)""",
    "keyword_postings": """SELECT 'tag' AS field, p_brand AS term, p_partkey AS doc_id, 1 AS tf
        FROM part WHERE p_brand IS NOT NULL""",
    "boolean_postings": """
        SELECT 'quality' AS field, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS term, doc_id, 1 AS tf
        FROM labels WHERE quality IS NOT NULL
        UNION ALL
        SELECT 'toxic', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, doc_id, 1
        FROM labels WHERE toxic IS NOT NULL""",
    "long_points": "SELECT 'count' AS field, CAST(p_size AS BIGINT) AS value, p_partkey AS doc_id FROM part WHERE p_size IS NOT NULL",
    "double_points": "SELECT 'price' AS field, p_retailprice AS value, p_partkey AS doc_id FROM part WHERE p_retailprice IS NOT NULL",
    "stored_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "term_dictionary": f"""WITH {TOK}
        SELECT 'text' AS field, term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_term_freq FROM post GROUP BY term
        UNION ALL SELECT 'lang', lang, count(*), count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang
        UNION ALL SELECT 'source', source, count(*), count(*) FROM documents WHERE source IS NOT NULL GROUP BY source""",
    "field_stats": f"""WITH {TOK}
        SELECT 'text' AS field, n AS doc_count, CAST(sum_length AS BIGINT) AS sum_length,
               round(avgdl, 6) AS avg_length FROM fstat""",
    "verify_build": """SELECT count(*) AS expected, count(*) AS found, true AS ok,
        CAST(NULL AS VARCHAR) AS message FROM documents""",
    "write_index": f"""WITH {TOK}
        SELECT 'stored' AS table_name, count(*) AS row_count FROM documents
        UNION ALL SELECT 'locations', count(*) FROM documents
        UNION ALL SELECT 'postings', (SELECT count(*) FROM post)
            + (SELECT count(lang) FROM documents) + (SELECT count(source) FROM documents)
        UNION ALL SELECT 'terms', (SELECT count(DISTINCT term) FROM post)
            + (SELECT count(DISTINCT lang) FROM documents) + (SELECT count(DISTINCT source) FROM documents)
        UNION ALL SELECT 'lengths', (SELECT count(*) FROM lens WHERE dl > 0)
        UNION ALL SELECT 'field_stats', (SELECT count(*) FROM fstat WHERE n > 0)
        UNION ALL SELECT 'blocks', (SELECT count(*) FROM (SELECT DISTINCT term, floor(doc_id / {BLOCK}) FROM post))
        UNION ALL SELECT 'long_points', (SELECT count(n_chars) FROM documents)""",
    "term_lookup_keyword": f"""SELECT p_partkey AS doc_id, 1 AS tf FROM part WHERE p_brand = {_q(iq.KEYWORD_TERM)}""",
    "term_lookup_text": f"""WITH {TOK} SELECT doc_id, tf FROM post WHERE term = {_q(iq.TEXT_TERM)}""",
    "bm25_topk": f"""WITH {TOK}, {BM25} SELECT rank, doc_id, round(score, 6) AS score FROM top""",
    "fetch_stored": f"""WITH {TOK}, {BM25}
        SELECT rank, doc_id, round(score, 6) AS score, lang, source, n_chars, text
        FROM top JOIN documents USING (doc_id)""",
    "numeric_range": f"""
        SELECT 'count' AS field, p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS value FROM part
        WHERE p_size BETWEEN {iq.LONG_RANGE[0]} AND {iq.LONG_RANGE[1]}
        UNION ALL
        SELECT 'price', p_partkey, p_retailprice FROM part
        WHERE p_retailprice BETWEEN {iq.DOUBLE_RANGE[0]} AND {iq.DOUBLE_RANGE[1]}""",
    "term_lookup_requests": f"""SELECT o_orderkey AS req_id, count(*) AS hits, min(p_partkey) AS first_doc, CAST(sum(p_partkey) AS BIGINT) AS doc_sum
        FROM orders JOIN part ON p_brand = 'Brand#' || (o_orderkey % {iq.REQUEST_TAGS}) GROUP BY o_orderkey""",
    "numeric_range_requests": f"""SELECT c_custkey AS req_id, count(*) AS hits, min(p_retailprice) AS least, max(p_retailprice) AS most
        FROM customer JOIN part ON p_retailprice >= c_custkey % 1000 + 900
             AND (c_custkey % 50 = 0 OR p_retailprice <= c_custkey % 1000 + 900 + {iq.RANGE_WIDTH}) GROUP BY c_custkey""",
    "sort_by_field": "SELECT p_partkey AS doc_id, p_retailprice AS price, p_brand AS tag FROM part ORDER BY price DESC NULLS LAST, doc_id",
}

"""DuckDB oracles for the ingest and validation queries (G1 by arithmetic)."""

from lexidx.plans.fixtures import G1_BAD_KINDS, G1_RULES, TWO_DOCS


def _kind_sql() -> str:
    arms = " ".join(f"WHEN p_partkey % {m} = {r} THEN '{n}'" for m, r, n in G1_RULES)
    return f"CASE {arms} ELSE 'ok' END"


ESC = "replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"

G1 = f"""g1 AS (
  SELECT p_partkey + 1 AS line, p_partkey AS k, p_name, p_brand, p_size, p_retailprice,
         {_kind_sql()} AS kind FROM part),
gl AS (
  SELECT *, CASE
    WHEN kind = 'blank' THEN CASE WHEN k % 194 = 0 THEN '' ELSE '   ' END
    WHEN kind = 'two_docs' THEN '{TWO_DOCS}'
    WHEN kind = 'not_json' THEN 'not json ' || CAST(k AS VARCHAR)
    ELSE '{{"title": ' || CASE WHEN kind = 'title_null' THEN 'null' ELSE '"' || {ESC.format(x='p_name')} || '"' END
      || ', "tag": ' || CASE WHEN kind = 'tag_int' THEN '123' ELSE '"' || {ESC.format(x='p_brand')} || '"' END
      || ', "count": ' || CASE WHEN kind = 'count_nan' THEN '"a dozen"'
                              WHEN kind = 'count_str' THEN '" ' || CAST(p_size AS VARCHAR) || ' "'
                              ELSE CAST(p_size AS VARCHAR) END
      || ', "price": ' || CAST(p_retailprice AS VARCHAR)
      || ', "in_stock": ' || CASE WHEN kind = 'stock_TRUE' THEN '"TRUE"' WHEN kind = 'stock_maybe' THEN '"maybe"'
                                 WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
      || CASE WHEN kind = 'bogus' THEN ', "bogus": 1' ELSE '' END || '}}'
  END AS value FROM g1),
obj AS (SELECT * FROM gl WHERE kind NOT IN ('blank', 'not_json', 'two_docs')),
msgs AS (
  SELECT line, kind, CASE kind
    WHEN 'bogus' THEN 'bogus' WHEN 'title_null' THEN 'title' WHEN 'count_nan' THEN 'count'
    WHEN 'stock_maybe' THEN 'in_stock' WHEN 'tag_int' THEN 'tag' END AS field,
  CASE kind
    WHEN 'bogus' THEN 'Line ' || line || ': unknown field ''bogus'''
    WHEN 'title_null' THEN 'Line ' || line || ': field ''title'' is null'
    WHEN 'count_nan' THEN 'Line ' || line || ': field ''count'' expected long but got String value ''a dozen'''
    WHEN 'stock_maybe' THEN 'Line ' || line || ': field ''in_stock'' expected boolean but got String value ''maybe'''
    WHEN 'tag_int' THEN 'Line ' || line || ': field ''tag'' expected keyword (string) but got Integer value ''123'''
    WHEN 'not_json' THEN 'Malformed JSON document'
    WHEN 'two_docs' THEN 'Trailing content after JSON document' END AS message
  FROM gl WHERE kind IN {G1_BAD_KINDS})"""

INGEST_SQL = {
    "ndjson_scan": f"WITH {G1} SELECT line, value FROM gl WHERE kind <> 'blank'",
    "json_fields": f"""WITH {G1}
      SELECT line, 0 AS position, 'title' AS field,
             CASE WHEN kind = 'title_null' THEN NULL ELSE 'String' END AS json_type,
             CASE WHEN kind = 'title_null' THEN NULL ELSE p_name END AS value FROM obj
      UNION ALL SELECT line, 1, 'tag', CASE WHEN kind = 'tag_int' THEN 'Integer' ELSE 'String' END,
             CASE WHEN kind = 'tag_int' THEN '123' ELSE p_brand END FROM obj
      UNION ALL SELECT line, 2, 'count', CASE WHEN kind IN ('count_nan', 'count_str') THEN 'String' ELSE 'Integer' END,
             CASE WHEN kind = 'count_nan' THEN 'a dozen'
                  WHEN kind = 'count_str' THEN ' ' || CAST(p_size AS VARCHAR) || ' '
                  ELSE CAST(p_size AS VARCHAR) END FROM obj
      UNION ALL SELECT line, 3, 'price', 'Double', CAST(p_retailprice AS VARCHAR) FROM obj
      UNION ALL SELECT line, 4, 'in_stock', CASE WHEN kind IN ('stock_TRUE', 'stock_maybe') THEN 'String' ELSE 'Boolean' END,
             CASE WHEN kind = 'stock_TRUE' THEN 'TRUE' WHEN kind = 'stock_maybe' THEN 'maybe'
                  WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM obj
      UNION ALL SELECT line, 5, 'bogus', 'Integer', '1' FROM obj WHERE kind = 'bogus'""",
    "malformed_lines": f"""WITH {G1} SELECT line, value, CASE kind WHEN 'not_json' THEN 'INVALID_JSON' ELSE 'TRAILING_CONTENT' END AS reason
      FROM gl WHERE kind IN ('not_json', 'two_docs')""",
    "unknown_fields": f"WITH {G1} SELECT line, field, message FROM msgs WHERE kind = 'bogus'",
    "null_fields": f"WITH {G1} SELECT line, field, message FROM msgs WHERE kind = 'title_null'",
    "type_mismatch_report": f"""WITH {G1} SELECT line, field, message FROM msgs
        WHERE kind IN ('count_nan', 'stock_maybe', 'tag_int')""",
    "coerce_keyword": f"""WITH {G1}
      SELECT o.line, 'tag' AS field, CASE WHEN kind = 'tag_int' THEN NULL ELSE p_brand END AS value,
             CASE WHEN kind = 'tag_int' THEN (SELECT message FROM msgs m WHERE m.line = o.line) END AS message
      FROM obj o""",
    "coerce_text": f"""WITH {G1}
      SELECT line, 'title' AS field, p_name AS value, CAST(NULL AS VARCHAR) AS message
      FROM obj WHERE kind <> 'title_null'""",
    "coerce_long": f"""WITH {G1}
      SELECT o.line, 'count' AS field, CASE WHEN kind = 'count_nan' THEN NULL ELSE CAST(p_size AS BIGINT) END AS value,
             CASE WHEN kind = 'count_nan' THEN (SELECT message FROM msgs m WHERE m.line = o.line) END AS message
      FROM obj o""",
    "coerce_double": f"""WITH {G1}
      SELECT line, 'price' AS field, p_retailprice AS value, CAST(NULL AS VARCHAR) AS message FROM obj""",
    "coerce_boolean": f"""WITH {G1}
      SELECT o.line, 'in_stock' AS field,
             CASE WHEN kind = 'stock_TRUE' THEN true WHEN kind = 'stock_maybe' THEN NULL ELSE p_size % 2 = 0 END AS value,
             CASE WHEN kind = 'stock_maybe' THEN (SELECT message FROM msgs m WHERE m.line = o.line) END AS message
      FROM obj o""",
    "first_error": f"WITH {G1} SELECT line, message FROM msgs ORDER BY line LIMIT 1",
    "typed_documents": f"""WITH {G1}
      SELECT line AS doc_id, p_name AS title, p_brand AS tag, CAST(p_size AS BIGINT) AS count,
             p_retailprice AS price, CASE WHEN kind = 'stock_TRUE' THEN true ELSE p_size % 2 = 0 END AS in_stock
      FROM obj WHERE kind NOT IN {G1_BAD_KINDS}""",
    "doc_count": f"""WITH {G1}
      SELECT count(*) AS doc_count, count(*) FILTER (WHERE kind IN {G1_BAD_KINDS}) AS failed_lines
      FROM gl WHERE kind <> 'blank'""",
}

"""DuckDB oracles for definitions, catalog and lifecycle queries.

The lifecycle oracle is a genuinely sequential fold (``list_reduce`` over
each version's ordered events), an independent check of the closed-form
Spark plan.
"""

from lexidx.plans import catalog_queries as cq
from lexidx.plans.fixtures import DEFINITION_TYPES, EVENT_KIND, PRIORITY_STATUS, READY_BELOW

_prio = " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in PRIORITY_STATUS)
_types = "[" + ", ".join(f"'{t}'" for t in DEFINITION_TYPES) + "]"
_kinds = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in EVENT_KIND)

G2 = f"""si AS (SELECT c_custkey AS index_id, lower(c_name) AS name FROM customer),
iv0 AS (SELECT o_orderkey AS version_id, o_custkey AS index_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version,
               CASE substr(o_orderpriority, 1, 1) {_prio} END AS status, o_totalprice FROM orders),
iv AS (SELECT version_id, index_id, version, status,
              CASE WHEN status IN ('UPLOADED', 'READY') THEN CAST(index_id AS VARCHAR) || '/' || CAST(version AS VARCHAR) || '/index.tar.gz' END AS artifact_key
       FROM iv0),
ireq AS (SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 300 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS index_id
         FROM orders),
vreq AS (SELECT version_id AS req_id, CASE WHEN version_id % 300 = 0 THEN index_id + 1000000 ELSE index_id END AS index_id,
                CASE WHEN version_id % 700 = 0 THEN version + 1000 ELSE version END AS version
         FROM iv),
res AS (SELECT r.req_id, r.index_id, r.version, v.version_id,
               CASE WHEN s.index_id IS NULL THEN 'INDEX_NOT_FOUND' WHEN v.version_id IS NULL THEN 'VERSION_NOT_FOUND' ELSE 'FOUND' END AS resolution,
               v.status, v.artifact_key,
               CASE WHEN s.index_id IS NULL THEN 'Index ' || r.index_id || ' not found'
                    WHEN v.version_id IS NULL THEN 'Version ' || r.version || ' not found for index ' || r.index_id END AS message
        FROM vreq r LEFT JOIN si s ON r.index_id = s.index_id
        LEFT JOIN iv v ON r.index_id = v.index_id AND r.version = v.version)"""

DEFS = f"""defs AS (
  SELECT c_custkey AS index_id,
         CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 11 = 0 THEN ''
              WHEN c_custkey % 13 = 0 THEN repeat('x', 70) ELSE lower(replace(c_name, '#', '_')) END AS name,
         CASE WHEN c_custkey % 17 = 0 THEN repeat(c_mktsegment, 60) ELSE c_mktsegment END AS description,
         CASE WHEN c_custkey % 19 = 0 THEN CAST([] AS STRUCT(name VARCHAR, type VARCHAR)[])
              ELSE [{{'name': 'title', 'type': 'text'}},
                    {{'name': CASE WHEN c_custkey % 23 = 0 THEN 'title' WHEN c_custkey % 29 = 0 THEN 'Bad Field' ELSE 'seg' END,
                      'type': ({_types})[c_nationkey % 6 + 1]}}] END AS fields
  FROM customer),
ff AS (SELECT index_id, unnest(fields) AS f FROM defs)"""

G3 = f"""ev AS (
  SELECT user_id AS version_id, event_id AS seq, ts,
         CASE WHEN event_type = 'error' THEN CASE WHEN value < {READY_BELOW} THEN 'READY' ELSE 'FAILED' END
              ELSE CASE event_type {_kinds} END END AS kind,
         CAST(floor(value) AS BIGINT) AS dc, CAST(floor(value * 100) AS BIGINT) AS sz, sha256(props) AS ck,
         CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) || '/index.tar.gz' AS ak,
         'error ' || props AS em
  FROM events),
per AS (SELECT version_id, list({{'seq': seq, 'ts': ts, 'kind': kind, 'dc': dc, 'sz': sz, 'ck': ck, 'ak': ak, 'em': em}} ORDER BY seq) AS evs
        FROM ev GROUP BY version_id),
folded AS (
  SELECT version_id, list_reduce(evs, lambda st, e:
    CASE
      WHEN st.status IS NULL AND e.kind = 'CREATED' THEN struct_pack(status := e.kind, dc := st.dc, sz := st.sz,
           ck := st.ck, ak := st.ak, em := st.em, n := st.n + 1, c_ts := e.ts, u_ts := e.ts)
      WHEN st.status IS NULL OR e.kind = 'CREATED' THEN st
      WHEN e.kind = 'BUILDING' OR (e.kind = 'READY' AND st.status = 'UPLOADED') THEN struct_pack(status := e.kind,
           dc := st.dc, sz := st.sz, ck := st.ck, ak := st.ak, em := st.em, n := st.n + 1, c_ts := st.c_ts, u_ts := e.ts)
      WHEN e.kind = 'BUILT' THEN struct_pack(status := e.kind, dc := e.dc, sz := e.sz, ck := e.ck, ak := st.ak,
           em := st.em, n := st.n + 1, c_ts := st.c_ts, u_ts := e.ts)
      WHEN e.kind = 'UPLOADED' THEN struct_pack(status := e.kind, dc := st.dc, sz := st.sz, ck := st.ck, ak := e.ak,
           em := st.em, n := st.n + 1, c_ts := st.c_ts, u_ts := e.ts)
      WHEN e.kind = 'FAILED' AND st.status <> 'READY' THEN struct_pack(status := e.kind, dc := CAST(NULL AS BIGINT),
           sz := CAST(NULL AS BIGINT), ck := CAST(NULL AS VARCHAR), ak := CAST(NULL AS VARCHAR), em := e.em,
           n := st.n + 1, c_ts := st.c_ts, u_ts := e.ts)
      ELSE st END,
    struct_pack(status := CAST(NULL AS VARCHAR), dc := CAST(NULL AS BIGINT), sz := CAST(NULL AS BIGINT),
                ck := CAST(NULL AS VARCHAR), ak := CAST(NULL AS VARCHAR), em := CAST(NULL AS VARCHAR),
                n := CAST(0 AS BIGINT), c_ts := CAST(NULL AS TIMESTAMP), u_ts := CAST(NULL AS TIMESTAMP))) AS st
  FROM per)"""

CATALOG_SQL = {
    "definition_audit": f"""WITH {DEFS}
      SELECT index_id, 'NAME_BLANK' AS rule, name AS subject FROM defs WHERE name IS NULL OR trim(name) = ''
      UNION ALL SELECT index_id, 'NAME_TOO_LONG', name FROM defs WHERE length(name) > 64
      UNION ALL SELECT index_id, 'NAME_PATTERN', name FROM defs
        WHERE NOT (name IS NULL OR trim(name) = '') AND NOT regexp_full_match(name, '[a-z0-9_-]+')
      UNION ALL SELECT index_id, 'DESCRIPTION_TOO_LONG', name FROM defs WHERE coalesce(length(description), 0) > 512
      UNION ALL SELECT index_id, 'NO_FIELDS', name FROM defs WHERE fields IS NULL OR len(fields) = 0
      UNION ALL SELECT index_id, 'DUPLICATE_FIELD_NAMES', name FROM defs
        WHERE len(fields) <> len(list_distinct(list_transform(fields, lambda x: x.name)))
      UNION ALL SELECT index_id, 'FIELD_NAME_BLANK', f.name FROM ff WHERE f.name IS NULL OR trim(f.name) = ''
      UNION ALL SELECT index_id, 'FIELD_NAME_TOO_LONG', f.name FROM ff WHERE length(f.name) > 64
      UNION ALL SELECT index_id, 'FIELD_NAME_PATTERN', f.name FROM ff
        WHERE NOT (f.name IS NULL OR trim(f.name) = '') AND NOT regexp_full_match(f.name, '[a-z0-9_]+')
      UNION ALL SELECT index_id, 'FIELD_TYPE_MISSING', f.name FROM ff WHERE f.type IS NULL
      UNION ALL SELECT index_id, 'FIELD_TYPE_UNKNOWN', f.name FROM ff
        WHERE f.type IS NOT NULL AND f.type NOT IN ('keyword', 'text', 'long', 'double', 'boolean')""",
    "fields_roundtrip": f"""WITH {DEFS},
      u AS (SELECT index_id, generate_subscripts(fields, 1) AS i, unnest(fields) AS f FROM defs),
      named AS (SELECT index_id, f.name AS name, min(i) AS first_i, lower(trim(arg_max(f.type, i))) AS type
                FROM u GROUP BY index_id, f.name)
      SELECT index_id, CAST(row_number() OVER (PARTITION BY index_id ORDER BY first_i) - 1 AS INTEGER) AS position, name, type
      FROM named""",
    "register_indexes": f"""WITH {G2},
      batch AS (SELECT c_custkey AS req_id,
                       CASE WHEN c_custkey % {cq.NAMELESS_MOD} = 0 THEN NULL
                            WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE 'fresh_' || CAST(c_custkey % 97 AS VARCHAR) END AS name
                FROM customer),
      b AS (SELECT *, name IS NULL OR name IN (SELECT name FROM si)
                      OR req_id <> min(req_id) OVER (PARTITION BY name) AS refused FROM batch)
      SELECT req_id, name, CASE WHEN refused THEN 'REFUSED' ELSE 'ACCEPTED' END AS status,
             CASE WHEN name IS NULL THEN 'Index name must not be blank'
                  WHEN refused THEN 'Index with name ''' || name || ''' already exists' END AS message FROM b""",
    "lookup_indexes": f"""WITH {G2}
      SELECT r.req_id, r.index_id, s.name, CASE WHEN s.name IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status,
             CASE WHEN s.name IS NULL THEN 'Index ' || r.index_id || ' not found' END AS message
      FROM ireq r LEFT JOIN si s USING (index_id)""",
    "list_indexes_page": f"""WITH {G2}
      SELECT index_id, name, (SELECT count(*) FROM si) AS total FROM si
      ORDER BY name, index_id LIMIT {cq.PAGE_SIZE} OFFSET {cq.PAGE * cq.PAGE_SIZE}""",
    "list_versions": f"""WITH {G2},
      req AS (SELECT CASE WHEN c_custkey % 500 = 3 THEN c_custkey + 1000000 ELSE c_custkey END AS index_id
              FROM customer)
      SELECT r.index_id, v.version, v.status, CAST(NULL AS VARCHAR) AS error
      FROM req r JOIN si USING (index_id) JOIN iv v USING (index_id)
      UNION ALL SELECT index_id, NULL, NULL, 'Index ' || index_id || ' not found' FROM req
      WHERE index_id NOT IN (SELECT index_id FROM si)""",
    "resolve_versions": f"""WITH {G2}
      SELECT req_id, index_id, version, version_id, resolution, status, message FROM res""",
    "next_version": f"""WITH {G2}
      SELECT s.index_id, CAST(coalesce(max(v.version), 0) + 1 AS INTEGER) AS next_version
      FROM si s LEFT JOIN iv v USING (index_id) GROUP BY s.index_id""",
    "active_builds": f"""WITH {G2}
      SELECT index_id, count(*) FILTER (WHERE status IN ('CREATED', 'BUILDING')) AS active_count,
             CASE WHEN count(*) FILTER (WHERE status IN ('CREATED', 'BUILDING')) > 0
                  THEN 'Index ' || index_id || ' already has an active build' END AS message
      FROM iv GROUP BY index_id""",
    "constraint_audit": f"""WITH {G2}
      SELECT 'DUPLICATE_NAME' AS rule, name AS subject, count(*) AS n FROM si GROUP BY name HAVING count(*) > 1
      UNION ALL SELECT 'DUPLICATE_VERSION', CAST(index_id AS VARCHAR) || ':' || CAST(version AS VARCHAR), count(*)
        FROM iv GROUP BY index_id, version HAVING count(*) > 1
      UNION ALL SELECT 'MULTIPLE_ACTIVE_BUILDS', CAST(index_id AS VARCHAR), count(*)
        FROM iv WHERE status IN ('CREATED', 'BUILDING') GROUP BY index_id HAVING count(*) > 1""",
    "cascade_delete": f"""WITH {G2}
      SELECT version_id, index_id, version, status FROM iv
      WHERE index_id IN (SELECT index_id FROM si WHERE index_id % 10 <> 0)""",
    "artifact_gate": f"""WITH {G2}
      SELECT req_id, index_id, version, status,
             CASE WHEN status IN ('UPLOADED', 'READY') THEN artifact_key END AS artifact_key,
             CASE WHEN status NOT IN ('UPLOADED', 'READY') THEN 'Artifact for version ' || version || ' of index '
                  || index_id || ' is not available (status=' || status || ')' END AS message
      FROM res WHERE resolution = 'FOUND'""",
    "version_state_fold": f"""WITH {G3}
      SELECT version_id, st.status AS status, st.dc AS doc_count, st.sz AS artifact_size, st.ck AS checksum,
             st.ak AS artifact_key, st.em AS error_message, st.n AS applied_events
      FROM folded WHERE st.status IS NOT NULL""",
    "audit_times": f"""WITH {G3}
      SELECT version_id, CAST(st.c_ts AS VARCHAR) AS created_at, CAST(st.u_ts AS VARCHAR) AS updated_at
      FROM folded WHERE st.status IS NOT NULL""",
}

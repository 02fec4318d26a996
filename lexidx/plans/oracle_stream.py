"""DuckDB oracles for the streaming queries."""

from lexidx.plans import stream_queries as sq
from lexidx.plans.oracle_catalog import G2, G3

STALE = f"""stale AS (
  SELECT version_id, list_reduce(evs, lambda st, e:
    CASE
      WHEN st.status IS NULL AND e.kind = 'CREATED' THEN struct_pack(status := e.kind, stale := st.stale)
      WHEN st.status IS NULL OR e.kind = 'CREATED' THEN st
      WHEN e.kind IN ('BUILDING', 'BUILT', 'UPLOADED') OR (e.kind = 'READY' AND st.status = 'UPLOADED')
        THEN struct_pack(status := e.kind, stale := st.stale)
      WHEN e.kind = 'FAILED' AND st.status = 'READY'
        THEN struct_pack(status := st.status, stale := list_append(st.stale, e.seq))
      WHEN e.kind = 'FAILED' THEN struct_pack(status := e.kind, stale := st.stale)
      ELSE st END,
    struct_pack(status := CAST(NULL AS VARCHAR), stale := CAST([] AS BIGINT[]))) AS st
  FROM per)"""

STREAM_SQL = {
    "event_source": f"""WITH {G2}
      SELECT CAST(iv0.version_id AS VARCHAR) AS versionId, CAST(iv0.index_id AS VARCHAR) AS indexId,
             iv0.version AS versionNumber, iv.artifact_key AS artifactKey,
             CAST(trunc(iv0.o_totalprice) AS BIGINT) AS artifactSize,
             sha256(CAST(iv0.version_id AS VARCHAR)) AS checksum,
             CAST(o.o_orderdate AS VARCHAR) AS occurredAt
      FROM iv0 JOIN iv USING (version_id) JOIN orders o ON o.o_orderkey = iv0.version_id
      WHERE iv.status IN ('UPLOADED', 'READY')""",
    "event_sink": f"""WITH {G2}
      SELECT CAST(iv0.index_id AS VARCHAR) AS key, '{{"versionId":"' || CAST(iv0.version_id AS VARCHAR) || '","indexId":"' || CAST(iv0.index_id AS VARCHAR)
             || '","versionNumber":' || CAST(iv0.version AS VARCHAR) || ',"artifactKey":"' || iv.artifact_key
             || '","artifactSize":' || CAST(CAST(trunc(iv0.o_totalprice) AS BIGINT) AS VARCHAR)
             || ',"checksum":"' || sha256(CAST(iv0.version_id AS VARCHAR))
             || '","occurredAt":"' || strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') || '"}}' AS value
      FROM iv0 JOIN iv USING (version_id) JOIN orders o ON o.o_orderkey = iv0.version_id
      WHERE iv.status IN ('UPLOADED', 'READY')""",
    "stale_failure_guard": f"""WITH {G3}, {STALE}
      SELECT version_id, unnest(st.stale) AS seq FROM stale""",
    "poison_routing": f"""WITH {G2},
      e AS (SELECT version_id, CAST(index_id AS VARCHAR) AS key FROM iv WHERE status IN ('UPLOADED', 'READY')),
      bad AS (SELECT key, '"poison ' || CAST(version_id AS VARCHAR) || '"' AS value
      FROM e WHERE version_id % {sq.POISON_STRING_MOD} = 0
      UNION ALL SELECT key, '{{"indexId": "' || key || '"}}'
      FROM e WHERE version_id % {sq.POISON_NO_ID_MOD} = 0 AND version_id % {sq.POISON_STRING_MOD} <> 0
      UNION ALL SELECT key, '{{"versionId": "' || CAST(version_id AS VARCHAR) || '", "versionNumber": "abc"}}'
      FROM e WHERE version_id % {sq.POISON_TYPE_MOD} = 0)
      SELECT key, value, sha256(value) AS raw_sha256, 'UNDECODABLE' AS reason FROM bad""",
    "ready_transition": f"""WITH {G3}
      SELECT version_id, st.status AS status, st.n AS applied_events FROM folded WHERE st.status IS NOT NULL""",
    "unknown_version_routing": f"""WITH {G3},
      c AS (SELECT version_id, min(seq) FILTER (WHERE kind = 'CREATED') AS created FROM ev GROUP BY version_id)
      SELECT version_id, seq, kind, 'UNKNOWN_VERSION' AS reason FROM ev JOIN c USING (version_id) WHERE created IS NULL OR seq < created""",
    "ambiguous_publish_reconcile": f"""WITH {G2}
      SELECT version_id, index_id, version, artifact_key FROM iv
      WHERE status = 'UPLOADED' AND version_id % {sq.UNCONFIRMED_MOD} = 0""",
    "publish_settlement": f"""WITH {G2},
      r AS (SELECT *, version_id % {sq.UNCONFIRMED_MOD} <> 0 AND version_id % {sq.REFUSED_MOD} = 0 AS refused FROM iv
            WHERE status IN ('UPLOADED', 'READY'))
      SELECT version_id, CASE WHEN refused THEN 'FAILED' ELSE status END AS status,
             CASE WHEN NOT refused THEN artifact_key END AS artifact_key, CASE WHEN refused THEN artifact_key END AS orphaned_key,
             CASE WHEN refused THEN 'Failed to publish event: broker ' || index_id END AS error_message FROM r""",
}

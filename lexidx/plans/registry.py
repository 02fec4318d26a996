
from lexidx.plans import (artifact_queries, catalog_queries, index_queries, ingest_queries,
                          oracle_artifact, oracle_catalog, oracle_index, oracle_ingest,
                          oracle_stream, stream_queries)

QUERIES = {}
QUERIES.update(ingest_queries.QUERIES)
QUERIES.update(index_queries.QUERIES)
QUERIES.update(catalog_queries.QUERIES)
QUERIES.update(artifact_queries.QUERIES)
QUERIES.update(stream_queries.QUERIES)

ORACLE_SQL = {}
ORACLE_SQL.update(oracle_ingest.INGEST_SQL)
ORACLE_SQL.update(oracle_index.INDEX_SQL)
ORACLE_SQL.update(oracle_catalog.CATALOG_SQL)
ORACLE_SQL.update(oracle_artifact.ARTIFACT_SQL)
ORACLE_SQL.update(oracle_stream.STREAM_SQL)

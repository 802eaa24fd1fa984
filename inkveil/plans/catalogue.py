"""All queries of the engine and their SQL, by name."""

from inkveil.plans import documents, files, limits, operations, records, streams

MODULES = (documents, operations, records, files, streams, limits)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}

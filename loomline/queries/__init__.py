"""Registered queries over the driver's tables with their DuckDB twins."""

from loomline.queries import batch, lifecycle, provenance, recall, streams, texts, twins

_PARTS = (recall, texts, batch, lifecycle, provenance, streams)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {**recall.ORACLE_SQL, **twins.ORACLE_SQL, **batch.ORACLE_SQL, **lifecycle.ORACLE_SQL, **provenance.ORACLE_SQL, **streams.ORACLE_SQL}

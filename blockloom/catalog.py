"""All queries of the library with their SQL."""

from .plans import context, endtoend, evaluation, graph, ingest, models, retrieval

_PARTS = (ingest, context, models, graph, endtoend, retrieval, evaluation)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}

"""All queries of the core, by name."""

from __future__ import annotations

from stratafold.plans import problems, relational, search, storage_queries, table_queries

_MODULES = (problems, relational, search, storage_queries, table_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
flagship = relational.QUERIES["q28_complex"]

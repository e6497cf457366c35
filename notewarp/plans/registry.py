"""All queries of the core by name, with the SQL that states the same result."""

from __future__ import annotations

from notewarp.plans import application, graph, incremental, knowledge, search

_PARTS = (incremental, graph, search, knowledge, application)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
FLAGSHIP = graph.traverse_nation

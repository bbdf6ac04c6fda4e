"""Named queries over the given tables, with the SQL that checks each."""

from __future__ import annotations

from steelyard.plans import analysis, facts, relational, reports, streams, text

FLAGSHIP = "fact_grid"
_ALL = facts.QUERIES | relational.QUERIES | analysis.QUERIES | text.QUERIES | streams.QUERIES | reports.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}

"""The registered queries and their SQL equivalents, family by family."""

from archivist.plans import catalog_queries, export_queries, search_queries, state_queries, upkeep_queries

MODULES = [catalog_queries, state_queries, search_queries, upkeep_queries, export_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}

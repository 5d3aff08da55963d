"""All registered queries of the library but the text operators', and their SQL."""

from gridlark.plans import call_oracles, call_queries, oracles, queries

QUERIES = queries.QUERIES | call_queries.QUERIES
ORACLES = oracles.ORACLES | call_oracles.ORACLES

__all__ = ["ORACLES", "QUERIES"]

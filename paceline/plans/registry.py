"""All queries over the relational tables by name, each with its SQL twin."""

from paceline.plans import record_queries, whole_queries

QUERIES = record_queries.QUERIES | whole_queries.QUERIES
ORACLES = record_queries.ORACLES | whole_queries.ORACLES

"""Registered queries and their SQL."""

from loomstone.plans import queries, queries_answers, queries_build, queries_index, queries_joins, queries_judged, queries_streams  # noqa: F401  all but the first register theirs

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
FLAGSHIP = queries.retrieve_context

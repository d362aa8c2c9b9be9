"""The registered queries; all of them are in queries.QUERIES."""

from huegrid.plans import map_queries, queries, record_queries, source_queries  # noqa: F401

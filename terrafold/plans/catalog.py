"""The registered queries over the reference tables and their SQL."""

from __future__ import annotations

from terrafold.plans import answer_queries, audit_queries, graph_queries, landing_queries, link_queries, more_queries, published_queries, ring_queries, spatial_queries, table_queries  # noqa: F401
from terrafold.plans.registry import QUERIES, SQL

FLAGSHIP = "licences_in_lens"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

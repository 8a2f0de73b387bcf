"""All query modules, imported for their registrations."""

from . import (  # noqa: F401
    graph_queries, harmonise_queries, ingest_queries, io_queries, join_queries, line_queries, order_queries, outing_queries, parts_queries, route_queries, scoring_queries, search_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries and their DuckDB forms."""

from pricepanel.registry import (  # noqa: F401
    queries_models,
    queries_panel,
    queries_products,
    queries_sellers,
    queries_sources,
)
from pricepanel.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

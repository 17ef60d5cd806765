"""All queries of the core library over the test tables."""

from __future__ import annotations

from . import catalog_queries, read_queries, state_queries, traffic_queries, verify_queries  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

"""All registered queries and their SQL."""

from ridgeline.catalog import (  # noqa: F401
    decisions, learning, models, rasters, routes, routing, scalars, streams, winds, zones)
from ridgeline.catalog.registry import QUERIES, oracle_sql

ORACLES = oracle_sql()
__all__ = ["ORACLES", "QUERIES"]

"""Queries over the driver tables, each with the SQL that checks it.

Modules register their queries on import; ``__spark_entry__`` serves them.
"""

from . import (  # noqa: F401
    anomaly_queries,
    decision_queries,
    extension_queries,
    forecast_queries,
    opportunity_queries,
    panel_queries,
    quality_queries,
    source_queries,
    spend_queries,
)
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]

"""All queries over the derived delivery log, with the SQL that checks them."""

from . import cost_queries, normalise_queries, process_queries, quality_queries, staffing_queries, stream_queries, waste_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cost_queries", "normalise_queries", "process_queries", "quality_queries", "staffing_queries", "stream_queries", "waste_queries"]

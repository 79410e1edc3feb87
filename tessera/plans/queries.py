"""All registered queries of the engine and the SQL that checks them."""

from tessera.plans import more_queries, read_queries, store_queries, text_queries, trace_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

FLAGSHIP = "a05_obligation_histogram"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

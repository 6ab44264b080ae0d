"""Named queries over the driver tables, with their SQL."""

from deltaloom.plans import cube_queries, flow_queries, ledger_queries
from deltaloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cube_queries", "flow_queries", "ledger_queries"]

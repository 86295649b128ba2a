"""Every operator as a query over the supplied tables, with the SQL that checks it."""

from . import q_aggregates, q_expressions, q_plans, q_relations, q_sources
from . import q_serving  # its checks are those of queries above
from .registry import CHECKS, QUERIES, check_sql, runnable

__all__ = [
    "CHECKS", "QUERIES", "check_sql", "q_aggregates", "q_expressions", "q_plans", "q_relations",
    "q_serving", "q_sources", "runnable",
]

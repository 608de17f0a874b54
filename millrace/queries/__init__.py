"""All registered queries."""

from millrace.queries import columns, explore, groups, power, tables, times  # noqa: F401
from millrace.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries of the campaign operators."""

from faultlens.plans import diagnosis, graph, metrics, models, relational, rows  # noqa: F401
from faultlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registered queries of the reference operators and their SQL."""

from presage.plans import q_joins, q_models, q_scalars, q_sources, q_stats, q_text  # noqa: F401
from presage.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

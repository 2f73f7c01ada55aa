"""All registered queries: importing this module registers every query module."""

from threadlens.plans import q_enrich, q_memo, q_misc, q_report, q_scalars, q_threads  # noqa: F401
from threadlens.plans.registry import QUERIES

__all__ = ["QUERIES"]

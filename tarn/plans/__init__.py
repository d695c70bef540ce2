"""Query catalogue: importing this package registers every query."""

from tarn.plans import functions, operators, relational, sessions, storage, tpch  # noqa: F401
from tarn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries: each maps (spark, sf_dir) to a DataFrame, most with an equal SQL text."""

from obsline.plans import calibration, coverage, flows, matching, ordered  # noqa: F401
from obsline.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

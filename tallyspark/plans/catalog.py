"""All named queries: importing the modules registers them."""

from tallyspark.plans import dates, metrics, profiles, store, surface  # noqa: F401
from tallyspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries: each runs an operator over whole tables, next to the SQL it must equal."""

from wicara.catalog import features, metrics, models, quality, rules, splits, stemming, text  # noqa: F401
from wicara.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries. Importing the package fills the registry."""

from wardlake.plans import features, gold, models, scorecard, series, tables, texts  # noqa: F401
from wardlake.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

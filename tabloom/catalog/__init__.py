"""The registered queries."""

from . import epochs, predictions, samples, scans  # noqa: F401  (importing registers the queries)
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

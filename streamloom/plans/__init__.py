"""Registered queries and their SQL."""

from . import control, formats  # noqa: F401 - they register their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

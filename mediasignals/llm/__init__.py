"""Operators for preparing training data; nothing else in the library imports this package."""

from . import queries
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "queries"]

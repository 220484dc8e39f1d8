"""Registered queries with their SQL checks; importing this package fills both tables."""

from . import cleaning, counts, evolution, models, revisions, sinks, tokens  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All registered catalogue queries and their oracle SQL."""

from __future__ import annotations

from . import catalog_queries, details, labels, layers, reviews, scenes, shots, stores, wide  # noqa: F401
from .adapters import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

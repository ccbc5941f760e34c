"""All queries of the engine with their SQL."""

from __future__ import annotations

from tessera.plans import knowledge, search, structure, versions  # noqa: F401  they register themselves
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

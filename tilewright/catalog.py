"""Registered queries of the tile engine and the SQL that must give the same rows."""

from __future__ import annotations

from tilewright.plans.oracles import ORACLES
from tilewright.plans.queries import QUERIES

FLAGSHIP = "lod_select"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

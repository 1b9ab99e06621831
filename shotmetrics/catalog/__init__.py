"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from . import causal, features, ingest, modeling, monitoring, reports, spatial  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

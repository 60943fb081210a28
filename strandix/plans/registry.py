"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""Registered queries of the recording engine and their DuckDB SQL."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

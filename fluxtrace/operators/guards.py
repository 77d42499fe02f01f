"""Checks of what operators are given."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The frame; an error if it is none, columns is no list of names, or a column is missing."""
    if not hasattr(frame, "columns") or not hasattr(frame, "schema"):
        raise TypeError("a DataFrame is needed")
    if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
        raise TypeError("columns must be a list of names")
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return frame


def require_rows(frame: DataFrame, name: str = "table") -> DataFrame:
    """The frame; an error if it has no rows."""
    if frame.isEmpty():
        raise ValueError(f"the {name} is empty")
    return frame

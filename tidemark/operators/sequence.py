"""Dense numbering of a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidemark.operators.segments import counted


def numbered(df: DataFrame, order: Column, ties: list[Column] | None = None, out: str = "rn", slices: int | None = None) -> DataFrame:
    """Add 1, 2, 3 ... in the order of a column, then of `ties`, which should make it unique; nulls come first. Parts are cut by all of these, so rows of
    one value of the first are not one task's."""
    by = {f"__o{i}": c for i, c in enumerate([order, *(ties or [])])}
    return counted(df.withColumns(by), [], list(by), out, slices).drop(*by)

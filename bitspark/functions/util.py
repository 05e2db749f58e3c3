"""Small helpers for column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x: Column | str | int | bool) -> Column:
    """A column by name, a literal of a number or truth value, or the column itself."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)

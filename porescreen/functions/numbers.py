"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Round and drop the sign of a negative zero, so that equal values have equal bits."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def missing_to_null(value: Column | str) -> Column:
    """NaN marks a missing value in the text inputs; tables use NULL."""
    column = F.col(value) if isinstance(value, str) else value
    return F.nanvl(column, F.lit(None).cast("double"))


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)

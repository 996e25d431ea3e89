"""Columns that bring spellings and bad numbers to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(column: Column | str) -> Column:
    """Outer spaces removed, upper case; null stays null."""
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def finite(column: Column | str) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def present(column: Column | str) -> Column:
    """True for numbers that are neither null nor NaN."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return c.isNotNull() & ~F.isnan(c)  # isnan(null) is false


def null_if_bad(column: Column | str) -> Column:
    """The number, or null where it is NaN or infinite."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(finite(c), c)

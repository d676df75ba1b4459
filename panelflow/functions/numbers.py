"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelflow.functions.text import as_col


def round_to(c: Column | str, digits: int = 2) -> Column:
    """Round a double, ties to the even digit, the way array libraries do."""
    factor = float(10**digits)
    return F.rint(as_col(c) * factor) / factor

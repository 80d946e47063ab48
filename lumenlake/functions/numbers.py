"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient, exact for all long values (``/`` goes through doubles)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))

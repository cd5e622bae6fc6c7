"""Shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo, hi) -> Column:
    """Value forced into [lo, hi]; null stays null, which least and greatest alone would skip."""
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (lo, hi))
    return F.when(c > hi, hi).when(c < lo, lo).otherwise(c)


def rounded(c, digits: int = 6) -> Column:
    """Round for comparison across engines; adding zero folds -0.0 into 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)

"""Bit and rounding helpers; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def trailing_zeros(x: Column) -> Column:
    """Number of zero bits below the lowest set bit; 64 for 0."""
    return F.when(x == 0, F.lit(64)).otherwise(F.bit_count((x.bitwiseAND(F.negate(x))) - F.lit(1))).cast("int")


def round_up(x: Column, multiple: int) -> Column:
    return F.ceil(x / multiple) * multiple

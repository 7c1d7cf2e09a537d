"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_mod(value: Column, divisor: int) -> Column:
    """Remainder in [0, divisor): -7 by 3 is 2."""
    if divisor <= 0:
        raise ValueError("divisor must be positive")
    return F.pmod(value, F.lit(divisor))


def fraction(value: Column) -> Column:
    """Distance from the floor."""
    return value - F.floor(value)


def half_even(value: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.rint(value)


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays of doubles."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def bin_values(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins whose first bin also holds the lowest edge; null outside and for NaN."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    result = F.when(F.isnan(value.cast("double")) | (value < edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        inside = value.isNotNull() if upper == float("inf") else value <= upper
        result = result.when(inside, F.lit(label))
    return result


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) drawn from the hash of ``parts``.

    Unlike ``rand`` it depends on the row only, so a retried task or another
    partitioning gives the same number.
    """
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))

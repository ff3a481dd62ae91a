"""Similarity of template vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The sum of the products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def soft_iou(both: Column, a_norm: Column, b_norm: Column) -> Column:
    """a.b / (a.a + b.b - a.b) from the three products; 0 where the denominator is 1e-6 or less."""
    under = a_norm + b_norm - both
    return F.when(under > 1e-6, both / under).otherwise(F.lit(0.0))


def rolled(image: Column, side: int, down: int, right: int) -> Column:
    """A square image, row by row, rolled around both edges."""
    at = F.sequence(F.lit(0), F.lit(side * side - 1))
    source = lambda k: F.pmod(F.floor(k / side).cast("int") - down, F.lit(side)) * side + F.pmod(k % side - right, F.lit(side))
    return F.transform(at, lambda k: F.element_at(image, source(k) + 1))

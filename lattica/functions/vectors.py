"""Column expressions on vectors (arrays of doubles) and on pixel addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(a: Column | str) -> Column:
    return _col(a).cast("array<double>")


def total(a: Column) -> Column:
    """Sum of an array, from the first element on."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def constant_one(a: Column, b: Column) -> Column:  # noqa: ARG001
    return F.lit(1.0)


def gaussian(d2: Column, sigma2: float) -> Column:
    """exp(-squared distance / sigma squared)."""
    return F.exp(-d2 / F.lit(float(sigma2)))


def chi_squared(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y), where x + y is not 0."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))


def approx_nonzeros(a: Column, tolerance: float = 1e-7) -> Column:
    return F.size(F.filter(a, lambda x: F.abs(x) > tolerance))


def power_sums(a: Column) -> Column:
    """p1 to pn of an array's n elements."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda p: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x, p)))


def elementary_symmetric(a: Column) -> Column:
    """e1 to en of an array's n elements: coefficients of the product of (1 + x t), a factor at a time."""
    one = F.array(F.lit(1.0))
    grow = lambda s, x: F.zip_with(F.concat(s, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), s), lambda u, v: u + x * v)
    e = F.aggregate(a, one, grow)
    return F.slice(e, F.lit(2), F.size(a))


def row_major(width: Column, r: Column, c: Column) -> Column:
    return r * width + c


def column_major(rows: Column, i: Column, j: Column) -> Column:
    return j * rows + i


def from_row_major(width: Column, i: Column) -> Column:
    """Struct of row and column."""
    return F.struct(F.floor(i / width).cast("long").alias("r"), (i % width).alias("c"))


def upper_triangular_packed(i: Column, j: Column) -> Column:
    """Place of (i, j), i <= j, in a packed upper triangle, column by column."""
    return (j * (j + 1) / 2).cast("long") + i


def hard_mask(m: Column) -> Column:
    """1 keeps a pixel: what is above 128 in a mask image is left out."""
    return F.when(m > 128, 0.0).otherwise(1.0)


def soft_mask(m: Column) -> Column:
    return 1 - m / 255


def alpha_mask(alpha: Column) -> Column:
    """A mask image's value from transparency."""
    return 255 - alpha

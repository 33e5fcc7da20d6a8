"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import let

HALF_MAX = 65504.0
UNIT_TOLERANCE = 1e-3


def norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vec: Column) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    return let(
        norm(vec),
        lambda n: F.transform(vec, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))),
    )


def off_unit(vec: Column) -> Column:
    """Distance of the length from one, null for a zero vector (such rows do not count)."""
    return let(norm(vec), lambda n: F.when(n > 0, F.abs(n - 1)))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def half_precision(vec: Column) -> Column:
    """Values as the 16-bit float format stores them (round half to even, gradual underflow)."""

    def rounded(x: Column) -> Column:
        v = x.cast("double")
        exponent = F.greatest(F.floor(F.log2(F.abs(v))).cast("double"), F.lit(-14.0)) - 10
        value = let(F.pow(F.lit(2.0), exponent), lambda step: F.rint(v / step) * step)
        return (
            F.when(v.isNull() | F.isnan(v) | (v == 0), v)
            .otherwise(let(value, lambda h: F.when(F.abs(h) > HALF_MAX, F.signum(v) * F.lit(float("inf"))).otherwise(h)))
            .cast("float")
        )

    return F.transform(vec, rounded)


def has_non_finite(vec: Column) -> Column:
    return F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())


def violation(vec: Column, dim: Column | int) -> Column:
    """Why a vector must be refused, or null: ``empty``, ``dimension`` or ``non_finite``."""
    width = dim if isinstance(dim, Column) else F.lit(dim)
    return (
        F.when(vec.isNull() | (F.size(vec) == 0), F.lit("empty"))
        .when(F.size(vec) != width, F.lit("dimension"))
        .when(has_non_finite(vec), F.lit("non_finite"))
    )

"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest magnitude of a quantised component.
INT8_MAX = 127


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    doubles = vector.cast("array<double>")

    def divided(norm: Column) -> Column:
        return F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles)

    # A lambda argument is computed once, an expression inside one per element.
    return F.transform(F.array(l2_norm(vector)), divided)[0]


def quantize_int8(vector: Column) -> Column:
    """Clamp to ±1, scale, round half away from zero."""

    def step(x: Column) -> Column:
        clamped = F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x))
        scaled = (clamped * F.lit(INT8_MAX).cast("float")).cast("double")
        return (F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("tinyint")

    return F.transform(vector.cast("array<float>"), step)

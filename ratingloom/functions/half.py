"""IEEE 754 binary16 rounding as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the binary16 format.
MIN_NORMAL_EXPONENT = -14
FRACTION_BITS = 10
OVERFLOW_THRESHOLD = 65520.0


def to_half(value: Column) -> Column:
    """Round to the nearest binary16 value, ties to even, subnormals kept.

    Magnitudes that would round past the largest finite value become infinite.
    """
    magnitude = F.abs(value.cast("double"))
    exponent = F.greatest(F.floor(F.log2(magnitude)), F.lit(MIN_NORMAL_EXPONENT))
    spacing = F.pow(F.lit(2.0), exponent - F.lit(FRACTION_BITS))
    rounded = F.rint(value / spacing) * spacing
    infinite = F.signum(value) * F.lit(float("inf"))
    return (F.when((magnitude == 0) | F.isnan(magnitude), value.cast("double"))
            .when(magnitude >= OVERFLOW_THRESHOLD, infinite)
            .otherwise(rounded))


def array_to_half(values: Column) -> Column:
    return F.transform(values, to_half)


def rounded_features(values: Column, precision: str) -> Column:
    """Bring an updated factor array back to the storage precision."""
    if precision == "double":
        return values
    single = values.cast("array<float>")
    if precision == "single":
        return single
    if precision == "half":
        return array_to_half(single).cast("array<float>")
    raise ValueError(f"unknown precision {precision!r}; use 'double', 'single' or 'half'")

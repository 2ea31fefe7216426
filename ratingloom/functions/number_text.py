"""Shortest-form number text (``%.<digits>g`` of C) as a column expression.

``format_string('%g')`` follows Java and keeps trailing zeros, so the text is
assembled here from the rounded significand and its decimal exponent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def general_format(value: Column, digits: int, width: int = 0) -> Column:
    """Text of a float32 value with ``digits`` significant digits, blank-padded to ``width``.

    A float32 times a power of ten is exact in double over the usual range, so
    ``rint`` breaks exact ties to even, as C does.
    """
    v = value.cast("float").cast("double")
    magnitude = F.abs(v)
    guess = F.floor(F.log10(magnitude)).cast("int")
    shift = F.lit(digits - 1) - guess
    # Dividing by a positive power keeps large magnitudes exact as well.
    scaled = F.when(shift >= 0, magnitude * F.pow(F.lit(10.0), shift)).otherwise(
        magnitude / F.pow(F.lit(10.0), -shift))
    rounded = F.rint(scaled).cast("long")
    carried = rounded >= 10**digits
    significand = F.when(carried, F.lit(10 ** (digits - 1)).cast("long")).otherwise(rounded)
    exponent = F.when(carried, guess + 1).otherwise(guess)

    figures = F.regexp_replace(significand.cast("string"), "0+$", "")
    head = F.substring(figures, 1, 1)
    tail = F.substring(figures, 2, digits)
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"),
                     F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    scientific = F.concat(head, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), power)

    whole_length = exponent + 1
    padded = F.rpad(figures, digits, "0")
    whole = padded.substr(F.lit(1), whole_length)
    fraction = F.regexp_replace(padded.substr(whole_length + 1, F.lit(digits)), "0+$", "")
    above_one = F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    below_one = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), figures)

    plain = F.when(exponent >= 0, above_one).otherwise(below_one)
    fixed_range = (exponent >= -4) & (exponent < digits)
    unsigned = (F.when(F.isnan(v), "nan")
                .when(magnitude == F.lit(float("inf")), "inf")
                .when(magnitude == 0, "0")
                .when(fixed_range, plain)
                .otherwise(scientific))
    negative = (v < 0) | F.startswith(v.cast("string"), F.lit("-"))
    text = F.concat(F.when(negative, "-").otherwise(""), unsigned)
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text) if width else text

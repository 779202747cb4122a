"""Rounded ratios that do not depend on the order in which executors add doubles.

Percentages and scores are compared with thresholds (5 %, 20 %, 85 points), so
a last-digit wobble can flip a verdict between two runs of the same job.  Where
numerator and denominator are whole numbers the rounding is therefore done in
BIGINT arithmetic, half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(num: Column, den: Column) -> Column:
    """Integral division of two whole-number columns."""
    return F.call_function("div", num.cast("bigint"), den.cast("bigint"))


def ratio(num: Column, den: Column, digits: int) -> Column:
    """``round(num / max(den, 1), digits)`` as DOUBLE, exact for whole numbers."""
    scale = 10**digits
    num = num.cast("bigint")
    den = F.greatest(den.cast("bigint"), F.lit(1))
    halves = whole_div(F.abs(num) * F.lit(2 * scale) + den, den * F.lit(2))
    return F.signum(num.cast("double")) * halves / F.lit(float(scale)) + F.lit(0.0)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share of ``part`` in ``whole`` in percent; 0 when ``whole`` is 0."""
    return ratio(part.cast("bigint") * F.lit(100), whole, digits)


def scaled(value: Column, digits: int) -> Column:
    """A value known to have ``digits`` decimals, as a whole number."""
    return F.round(value * F.lit(10**digits)).cast("bigint")


def mean_of(value: Column, value_digits: int, digits: int) -> Column:
    """Aggregate: mean of a column with ``value_digits`` decimals, rounded exactly."""
    total = F.sum(scaled(value, value_digits))
    return ratio(total, F.count(value) * F.lit(10**value_digits), digits)

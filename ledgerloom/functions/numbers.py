"""Rounding as printed reports do it (ties go to the even digit) and sums free of order.

All of it is arithmetic on doubles and longs: a cast from double to decimal goes through
text for every row, which costs more than the rest of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _units(size: Column, places: int) -> Column:
    """Nearest whole number of 10^-places to a size that is not negative.

    ``size * scale`` is itself rounded, which would move numbers such as 4.835 (stored a
    little below) onto a tie. The number is therefore split into halves of few enough bits
    that their products are exact, and the sign of the distance to the midpoint decides.
    """
    scale = float(10 ** places)
    low = F.floor(size * scale)
    wide = size * 134217729.0
    head = wide - (wide - size)
    past = (head * (2 * scale) - (low * 2 + 1).cast("double")) + (size - head) * (2 * scale)
    return low + F.when(past > 0, 1).when(past < 0, 0).otherwise(low % 2)


def rounded(value: Column, places: int) -> Column:
    number = value.cast("double")
    return F.signum(number) * _units(F.abs(number), places) / float(10 ** places)


def fixed(value: Column, places: int) -> Column:
    """Text with exactly ``places`` decimals, for numbers below 10^11."""
    number = value.cast("double")
    units = _units(F.abs(number), places)
    sign = F.when(number < 0, "-").otherwise("")
    if places == 0:
        return F.concat(sign, units.cast("string"))
    whole = F.floor(units / 10 ** places)
    rest = F.lpad((units % 10 ** places).cast("string"), places, "0")
    return F.concat(sign, whole.cast("string"), F.lit("."), rest)


def exact_sum(value: Column, places: int = 4) -> Column:
    """Sum of numbers with at most ``places`` decimals; the same in whatever order they come."""
    scale = float(10 ** places)
    return F.sum(F.rint(value * scale).cast("bigint")) / scale


def exact_mean(value: Column, places: int = 4) -> Column:
    return exact_sum(value, places) / F.count(value)

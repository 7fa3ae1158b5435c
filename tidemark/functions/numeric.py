"""Decimal and time arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(16,14)"


def ratio(num: Column, den: Column) -> Column:
    """num / den with 14 decimal places; NULL for a zero denominator.

    Sums of money are narrowed first: a quotient of two full-width decimals would keep 6 places only.
    """
    return F.try_divide(num.cast("decimal(30,12)"), den.cast("decimal(24,6)"))


def decimal_ratio(num: Column, den: Column) -> Column:
    """num / den of two price differences, 6 places, ties to even."""
    return F.bround(F.try_divide(num.cast("decimal(17,14)"), den.cast("decimal(17,14)")), 6) \
        .cast("decimal(18,6)")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("decimal(1,0)"), F.least(F.lit(1).cast("decimal(1,0)"), c))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes to one decimal."""
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0), 1)


def usdc(units: Column) -> Column:
    """Integer base units (millionths) to a decimal amount."""
    return (units.cast("decimal(30,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(30,6)")

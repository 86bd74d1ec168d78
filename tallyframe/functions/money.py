"""Money, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(value: Column | float | int) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return col.cast(MONEY)


def dbl(value: Column) -> Column:
    return value.cast("double")


def rounded(value: Column | str, digits: int) -> Column:
    """Double rounded half away from zero on the scaled value."""
    col = dbl(F.col(value) if isinstance(value, str) else value)
    scale = float(10**digits)
    return F.signum(col) * F.floor(F.abs(col) * scale + 0.5) / F.lit(scale)


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Rounded quotient as double; a zero denominator gives NULL."""
    return rounded(F.try_divide(dbl(numerator), dbl(denominator)), digits)


def ratio_or_zero(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Quotient when the denominator is positive, else 0."""
    return F.when(denominator > 0, ratio(numerator, denominator, digits)).otherwise(F.lit(0.0))


def percent_or_zero(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    quotient = F.try_divide(dbl(numerator), dbl(denominator)) * F.lit(100.0)
    return F.when(denominator > 0, rounded(quotient, digits)).otherwise(F.lit(0.0))


def round_floor(value: Column, digits: int = 2) -> Column:
    """Round half towards plus infinity: floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(dbl(value) * scale + 0.5) / F.lit(scale)


def inflow(amount: Column) -> Column:
    return F.when(amount > 0, amount).otherwise(F.lit(0).cast(MONEY))


def outflow(amount: Column) -> Column:
    return F.when(amount < 0, -amount).otherwise(F.lit(0).cast(MONEY))


def total(value: Column) -> Column:
    """Sum that is 0 rather than NULL on an empty or all-null group."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(28,2)")

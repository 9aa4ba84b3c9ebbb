"""Exact money: stored amounts become whole cents or decimals first, and are multiplied as such."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CENTS = "decimal(12,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    return _c(x).cast(CENTS)


def _part(gross, hundredths: Column) -> Column:
    """gross * hundredths / 100 in whole cents, rounded half away from zero, as decimal.

    Both factors are whole numbers, so the product is exact and stays in plain
    long arithmetic; only the result becomes a decimal.
    """
    p = cents(gross) * hundredths
    rounded = F.call_function("div", p + F.when(p < 0, -50).otherwise(50), F.lit(100))
    return (rounded.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(CENTS)


def net(gross, discount) -> Column:
    """gross * (1 - discount), rounded to cents per row."""
    return _part(gross, F.lit(100) - cents(discount))


def share_of(gross, rate) -> Column:
    """gross * rate, rounded to cents per row."""
    return _part(gross, cents(rate))


def cents(x) -> Column:
    """A double or decimal amount as whole cents, for exact running sums."""
    return F.round(_c(x) * 100).cast("bigint")


def ratio(num, den, digits: int = 6) -> Column:
    """Sum over sum as a rounded double; NULL where the denominator is 0 or NULL."""
    d = _c(den).cast("double")
    return F.round(_c(num).cast("double") / F.when(d != 0, d), digits)


def dbl(x) -> Column:
    return _c(x).cast("double")

"""Number functions: money in pennies, half-even rounding, scores and moves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int) -> Column:
    """Round to ``digits`` places, ties to the even digit."""
    scale = 10.0**digits
    return F.rint(c * scale) / scale


def pennies(c: Column) -> Column:
    """An amount as whole pennies, half a penny up."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def penny_median(c: Column) -> Column:
    """The exact median of an amount, half a penny up. For groups that are small by nature; see
    ``operators.medians`` for groups of any size."""
    return F.floor(F.median(pennies(c)) + 0.5) / 100.0


def geo_mean(c: Column) -> Column:
    """Geometric mean of positive numbers."""
    return F.exp(F.avg(F.ln(c)))


def move(now: Column, before: Column, limit: float) -> Column:
    """Log of the move from ``before`` to ``now``; NULL when it is missing or beyond the limit either way."""
    ratio = F.try_divide(now, before)
    return F.when(ratio.between(1 / limit, limit), F.ln(ratio))


def momentum(recent: Column, prior: Column, recent_days: int = 3, baseline_days: int = 11) -> Column:
    """50 at the usual pace of mentions, 100 at four times it, 0 at a quarter."""
    ratio = ((recent + 2) / F.lit(recent_days)) / ((prior + 6) / F.lit(baseline_days))
    return clamp(50 + 33 * F.log2(ratio))


def price_of(value: Column, currency: Column, wanted: Column) -> Column:
    """A positive amount in the wanted currency, else NULL."""
    number = value.try_cast("double")
    return F.when((currency == wanted) & (number > 0), number)


def cheapest_postage(options: Column, currency: Column) -> Column:
    """The cheapest quote in the site's currency over an array of {cost, currency}; NULL when none."""
    quotes = F.filter(options, lambda o: o["currency"] == currency)
    return F.array_min(F.transform(quotes, lambda o: o["cost"].try_cast("double")))


def view_count(c: Column) -> Column:
    """A view count as a non-negative whole number, else NULL."""
    number = F.trim(c.cast("string")).try_cast("bigint")
    return F.when(number >= 0, number)


def month_index(month: Column) -> Column:
    """"2026-10" as a running month number; NULL when it is no month."""
    ok = month.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 6, 2).try_cast("int") - 1)

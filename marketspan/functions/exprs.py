"""Column expressions with the fail-closed null rules of merchant metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(n: Column, d: Column) -> Column:
    """n / d as a double; null if d is null or 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def sum_if_complete(c: Column) -> Column:
    """The sum, or null if any row lacks a value."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def percent_change(now: Column, then: Column) -> Column:
    """Change relative to abs(then): 0 from 0 to 0, null from 0 to anything else or without evidence."""
    return F.when((then == 0) & (now == 0), 0.0).when(then != 0, (now - then).cast("double") / F.abs(then).cast("double"))


def rule_change(now: Column, then: Column) -> Column:
    """The rules' change: null for any zero baseline."""
    return F.when(then != 0, (now - then).cast("double") / F.abs(then).cast("double"))


def point_change(now: Column, then: Column) -> Column:
    return now - then


def weighted_by(value: Column, weight: Column) -> Column:
    """Weighted sum of rows that have a value, over all rows' weight."""
    return safe_div(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(weight))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def complement(c: Column) -> Column:
    """1 - c within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), clamp01(1 - c))


def stage_drop(n: Column, d: Column) -> Column:
    """The share of d that n lacks; null unless n is from 0 to a d above 0."""
    return F.when((d > 0) & n.between(0, d), 1 - n / d)


def half_up(c: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def numeric(c: Column) -> Column:
    """A finite number, else 0."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def period_label(date: Column, current: tuple[str, str], comparison: tuple[str, str]) -> Column:
    """CURRENT or COMPARISON for half-open date ranges, else null."""
    def inside(r):
        return (date >= F.lit(r[0]).cast("date")) & (date < F.lit(r[1]).cast("date"))

    return F.when(inside(current), "CURRENT").when(inside(comparison), "COMPARISON")


def customer_segment(index: Column, ready: Column) -> Column:
    """NEW for a customer's first order, RETURNING for later ones, UNKNOWN without a ready, positive index."""
    known = F.coalesce(ready, F.lit(False)) & (index >= 1)
    return F.when(known & (index == 1), "NEW").when(known, "RETURNING").otherwise("UNKNOWN")


def selected(c: Column, chosen: list) -> Column:
    """Membership; an empty choice selects nothing."""
    return c.isin(chosen) if chosen else F.lit(False)


def distinct_sorted(c: Column) -> Column:
    """The distinct values that are not null, sorted; empty without any."""
    return F.sort_array(F.collect_set(c))

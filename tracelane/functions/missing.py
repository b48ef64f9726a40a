"""Missing-value rules that differ from Spark's defaults.

Spark aggregates skip nulls and ``otherwise`` swallows a null condition.  The analyses here were
written for a language in which a missing value spreads unless told otherwise, so each rule gets a
named helper instead of being re-derived at every call site.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice in which an unknown condition gives null (not the ``no`` branch)."""
    return F.when(cond, yes).when(~cond, no)


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test that is false, never null, for a null input (so its negation keeps nulls)."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def _strict(agg, c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c: Column | str) -> Column:
    return _strict(F.sum, c)


def strict_avg(c: Column | str) -> Column:
    """Mean that is null as soon as one value of the group is null."""
    return _strict(F.avg, c)


def strict_min(c: Column | str) -> Column:
    return _strict(F.min, c)


def strict_max(c: Column | str) -> Column:
    return _strict(F.max, c)


def na_text(c: Column | str) -> Column:
    """Text form in which null is spelled ``NA``."""
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def number_text(c: Column | str) -> Column:
    """A double as text with at most 15 significant digits and no trailing ``.0``; null is ``NA``."""
    c = _col(c).cast("double")
    size = F.abs(c)
    rounded = F.round(c, 6)
    for power in range(7, -4, -1):
        rounded = F.when(size < 10.0**power, F.round(c, 15 - power)).otherwise(rounded)
    whole = (size < 1e15) & (c == F.floor(c))
    return F.coalesce(
        F.when(whole, c.cast("long").cast("string")).otherwise(rounded.cast("string")), F.lit("NA")
    )

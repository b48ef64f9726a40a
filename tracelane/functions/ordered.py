"""Aggregates that depend on row order or on a row condition.

Spark rows have no order, so every "first" and "last" names the sequence column that defines it.
With numeric values and a numeric sequence these stay hash aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.missing import _col


def first_where(value: Column | str, cond: Column | None, seq: Column | str) -> Column:
    """Value (null included) at the lowest ``seq`` among rows that meet ``cond``."""
    order = _col(seq) if cond is None else F.when(cond, _col(seq))
    return F.min_by(_col(value), order)


def last_where(value: Column | str, cond: Column | None, seq: Column | str) -> Column:
    """Value (null included) at the highest ``seq`` among rows that meet ``cond``."""
    order = _col(seq) if cond is None else F.when(cond, _col(seq))
    return F.max_by(_col(value), order)


def share_where(cond: Column) -> Column:
    """Share of the group's rows that meet ``cond``; unknown counts as not met."""
    return F.count_if(cond) / F.count(F.lit(1))


def any_equal(c: Column | str, value) -> Column:
    """1 when some row of the group equals ``value``, else 0 (never null)."""
    return F.bool_or(_col(c).eqNullSafe(F.lit(value))).cast("int")


def distinct_where(c: Column | str, cond: Column | None = None) -> Column:
    """Number of different values among the rows that meet ``cond``."""
    c = _col(c)
    return F.count_distinct(c if cond is None else F.when(cond, c))


def ordered_list(c: Column | str, seq: Column | str) -> Column:
    """All values of the group as an array in ``seq`` order (the array is the result: nothing is cut)."""
    pairs = F.array_sort(F.collect_list(F.struct(_col(seq).alias("s"), _col(c).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def ordered_concat(c: Column | str, seq: Column | str, sep: str = ", ", null: str = "NA") -> Column:
    """All values of the group joined into one text in ``seq`` order."""
    text = ordered_list(_col(c).cast("string"), seq)
    return F.array_join(text, sep, null)

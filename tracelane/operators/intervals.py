"""Sums over an integer axis of rows that each hold for an interval of it, without spreading the intervals.

A row that holds from ``low`` to ``high`` adds its values at ``low`` and takes them back behind ``high``.  Added up
per place and then along the axis, these changes give the sums between every two places at which anything changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.operators import skew

def spread(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row per place of ``low..high`` (as ``__at``), built from arrays of bounded length."""
    size = skew.BLOCK
    pieces = df.withColumn("__from", F.explode(F.sequence(low, high, F.lit(size).cast("long"))))
    last = F.least(F.col("__from") + F.lit(size - 1), high)
    return pieces.withColumn("__at", F.explode(F.sequence(F.col("__from"), last)))


def running_totals(
    rows: DataFrame, keys: list[str], sums: dict[str, Column], low: str = "low", high: str = "high"
) -> DataFrame:
    """``keys, low, high`` and the totals of ``sums`` over the rows that hold there, for each stretch of the axis.

    Stretches lie between neighbouring places where some row begins or ends; totals of long values are exact, those
    of doubles keep the rounding of what was added and taken back, so a count should say where nothing holds.  Rows
    are summed per place before they are shuffled: however many rows a key has, its window holds no more of them
    than the axis has places.
    """
    names = list(sums)
    valued = rows.select(*keys, F.col(low).alias("__low"), F.col(high).alias("__high"), *[c.alias(n) for n, c in sums.items()])
    begin = F.struct(F.col("__low").alias("low"), *names)
    end = F.struct((F.col("__high") + F.lit(1)).alias("low"), *[(-F.col(n)).alias(n) for n in names])
    changes = valued.select(*keys, F.inline(F.array(begin, end))).groupBy(*keys, "low")
    changes = changes.agg(*[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy(*keys).orderBy("low")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    then = (F.lead("low").over(order) - F.lit(1)).alias("high")
    totals = changes.select(*keys, "low", then, *[F.sum(n).over(so_far).alias(n) for n in names])
    return totals.filter(F.col("high").isNotNull())


def sum_of_places(low: Column, high: Column) -> Column:
    """Sum of ``low, low + 1, ..., high`` as an exact whole number."""
    a, b = low.cast("decimal(18,0)"), high.cast("decimal(18,0)")
    return ((a + b) * (b - a + F.lit(1)) / F.lit(2)).cast("decimal(38,0)")


def sum_of_squares(low: Column, high: Column) -> Column:
    """Sum of the squares of ``low, low + 1, ..., high``, likewise."""

    def up_to(k: Column) -> Column:
        k = k.cast("decimal(12,0)")  # six times the answer must fit in 38 digits
        return k * (k + F.lit(1)) * (F.lit(2) * k + F.lit(1))

    return ((up_to(high) - up_to(low - F.lit(1))) / F.lit(6)).cast("decimal(38,0)")

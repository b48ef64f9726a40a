"""Join helpers with the null and key rules of the analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.operators.skew import salted_left_join


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    keys: list[str] | None = None,
    null_safe: bool = True,
    spread: list[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on the shared column names (or on ``keys``), null keys matching null keys.

    Columns of ``right`` that also exist on the left are dropped; for a right join the key values come
    from the right side.  A left join with ``spread`` spreads heavy keys by a hash of these columns
    (``salted_left_join``); ``hot`` may name the heavy keys.
    """
    if how not in ("left", "right", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = keys or [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no shared columns to join on")
    for k in keys:
        if k not in left.columns or k not in right.columns:
            raise ValueError(f"join key {k!r} is missing on one side")
    kept = [c for c in right.columns if c not in left.columns]
    if spread:
        if how != "left":
            raise ValueError("only left joins are spread")
        return salted_left_join(left, right.select(*keys, *kept), keys, spread, hot, null_safe=null_safe)
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *kept)

    def pair(k: str):
        mine, theirs = left[k], other[f"__r_{k}"]
        return mine.eqNullSafe(theirs) if null_safe else mine == theirs

    joined = left.join(other, reduce(lambda a, b: a & b, [pair(k) for k in keys]), how)
    if how == "right":
        mine = [F.col(f"__r_{c}").alias(c) if c in keys else F.col(c) for c in left.columns]
    else:
        mine = [F.col(c) for c in left.columns]
    return joined.select(*mine, *kept)


def membership_flag(
    df: DataFrame,
    col: str,
    other: DataFrame,
    other_col: str,
    name: str,
    spread: list[str] | None = None,
) -> DataFrame:
    """Add a boolean telling whether ``col`` occurs in ``other``; never null, null is found in null."""
    members = other.select(F.col(other_col).alias(col), F.lit(True).alias(name)).distinct()
    joined = salted_left_join(df, members, [col], spread or df.columns, null_safe=True)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def attach_durations(
    rows: DataFrame,
    durations: DataFrame,
    keys: tuple[str, ...] = ("condition", "item"),
    spread: list[str] | None = None,
) -> DataFrame:
    """Lookup join of audio durations; Spark broadcasts the table when its size allows.

    ``spread`` names the columns by which raw events of one recording are spread beyond that size.
    """
    return natural_join(rows, durations, "left", list(keys), null_safe=False, spread=spread)

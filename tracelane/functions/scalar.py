"""Row-level functions of the trajectory model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.missing import _col, if_else, matches


def to_bin(c: Column | str, step: float) -> Column:
    """Index of the nearest multiple of ``step``; halves go to the even index.

    The result is an integer so that it is a safe grouping key (no -0.0, no float drift).
    """
    return F.rint(_col(c) / F.lit(float(step))).cast("long")


def mround(c: Column | str, step: int) -> Column:
    """Nearest multiple of ``step`` (half to even)."""
    return to_bin(c, step) * F.lit(int(step))


def condition_side(c: Column | str) -> Column:
    """Side of the referent: the last character of a condition code such as ``1_3FluentL``."""
    return F.right(_col(c), F.lit(1))


def condition_name(c: Column | str) -> Column:
    """Condition without its side letter, digits and underscores (``1_3FluentL`` -> ``Fluent``)."""
    c = _col(c)
    return F.regexp_replace(F.left(c, F.length(c) - F.lit(1)), "[0-9_]", "")


def click_side(layer: Column | str) -> Column:
    """``L``, ``R`` or ``none`` from the name of the clicked layer (null layer: ``none``)."""
    layer = _col(layer)
    return F.when(matches(layer, "left"), "L").when(matches(layer, "right"), "R").otherwise("none")


def object_chosen(side: Column | str, refpos: Column | str) -> Column:
    """``ref`` when the clicked side is the referent's, ``dis`` for the other side, else ``none``."""
    side, refpos = _col(side), _col(refpos)
    return F.when(side == "none", "none").otherwise(if_else(side == refpos, F.lit("ref"), F.lit("dis")))


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace listed levels; every other value, and null, stays as it is."""
    c = _col(c)
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def level_code(c: Column | str, levels: list[str]) -> Column:
    """1-based position of a value in an explicit level list; null for a value outside it."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.nullif(pos, F.lit(0).cast("long")).cast("int")


def code_values(c: Column | str, codes: dict[str, float]) -> Column:
    """Numeric contrast code of each level; null for a value without one."""
    c = _col(c)
    out = F.lit(None).cast("double")
    for level, code in codes.items():
        out = F.when(c == level, F.lit(float(code))).otherwise(out)
    return out


def elog(p: Column | str, n: float = 1.0, mode: str = "as_written") -> Column:
    """Empirical logit of a proportion.

    ``as_written`` follows the analysis text, where the division binds tighter than the first
    addition; ``standard`` is the textbook ratio.
    """
    p, half, n = _col(p), F.lit(0.5), F.lit(float(n))
    if mode == "as_written":
        return F.log(p + half / (n - p + half))
    if mode == "standard":
        return F.log((p + half) / (n - p + half))
    raise ValueError(f"unknown elog mode {mode!r}")


def move_category(ref: Column | str, dis: Column | str) -> Column:
    """Which object the cursor has moved towards more: ``ref``, ``dist`` or ``neither``."""
    ref, dis = _col(ref), _col(dis)
    return F.when(ref > dis, "ref").when(dis > ref, "dist").when(ref == dis, "neither")


def epoch_ms_to_ts(c: Column | str) -> Column:
    """Epoch milliseconds to a timestamp, cut to whole seconds."""
    return F.timestamp_seconds(F.floor(_col(c) / F.lit(1000.0)))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_seconds(_col(end)) - F.unix_seconds(_col(start))) / F.lit(60.0)


def chi_square_p(statistic: Column | str, dof: Column | str) -> Column:
    """Probability of a chi-square value at least as large: the upper incomplete gamma function, regularised.

    Below the mean a power series, above it a continued fraction, both of a length that grows with the square root of
    the degrees of freedom.  Null for an unknown statistic or no degrees of freedom.
    """
    x, k = _col(statistic).cast("double") / F.lit(2.0), _col(dof).cast("long")
    a = k.cast("double") / F.lit(2.0)
    one, tiny = F.lit(1.0), F.lit(1e-300)
    places = F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long") + F.ceil(F.sqrt(a) * F.lit(20.0)))
    # log of gamma(a) from gamma(1) or gamma(1/2) upwards
    half = F.pmod(k, F.lit(2)).cast("double") / F.lit(2.0)
    steps = F.when(k > 2, F.sequence(F.lit(1).cast("long"), F.floor((k - F.lit(1)) / F.lit(2)).cast("long")))
    first = F.when(half > 0, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    shift = F.when(half > 0, F.lit(-0.5)).otherwise(F.lit(0.0))
    log_gamma = F.coalesce(F.aggregate(steps, first, lambda s, i: s + F.log(i.cast("double") + shift)), first)
    front = F.exp(a * F.log(x) - x - log_gamma)

    def add(s, i):
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(places, F.struct((one / a).alias("term"), (one / a).alias("sum")), add)["sum"]

    def deepen(s, i):
        top = i * (a - i)
        low = x + one - a + F.lit(2.0) * i
        d = one / _not_zero(top * s["d"] + low, tiny)
        c = _not_zero(low + top / s["c"], tiny)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    begin = one / _not_zero(x + one - a, tiny)
    fraction = F.aggregate(places, F.struct((one / tiny).alias("c"), begin.alias("d"), begin.alias("h")), deepen)["h"]
    upper = F.when(x <= 0, one).when(x < a + one, F.greatest(one - front * series, F.lit(0.0))).otherwise(front * fraction)
    return F.when((k > 0) & x.isNotNull(), upper)


def _not_zero(c: Column, tiny: Column) -> Column:
    return F.when(F.abs(c) < tiny, tiny).otherwise(c)

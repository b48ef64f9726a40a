"""Resampling of irregular cursor samples to a fixed time grid, and movement features on that grid.

Two routes give the same rows:

* ``bin_mean`` -> ``gap_fill`` -> ``movement_features``: the steps one by one, for any input;
* ``trajectories``: the whole chain fused.  Features are computed on the *observed* bins and spread over
  the grid last, so the wide grid is never shuffled, joined or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions import to_bin
from tracelane.operators.intervals import spread
from tracelane.operators.skew import (
    block_of,
    blocked,
    carried,
    heaviest,
    hot_keys,
    last_known_before,
    salted_left_join,
)
from tracelane.operators.trials import TRIAL, trial_clock

# fixed value: sampling grid in milliseconds
STEP_MS = 20

FEATURES = [
    "x_step_end",
    "distance_travelled",
    "cumulative_distance",
    "ldist",
    "rdist",
    "ref_dist",
    "dis_dist",
    "ref_cdist",
    "dis_cdist",
    "refprop",
    "disprop",
]


def bin_mean(
    df: DataFrame, keys: list[str], bin: Column, values: list[str], where: Column | None = None
) -> DataFrame:
    """Mean of each value per group and bin; null when any value of the bin is null."""
    rows = df if where is None else df.filter(where)
    n = F.count(F.lit(1))
    means = [F.when(F.count(v) == n, F.avg(v)).alias(v) for v in values]
    return rows.groupBy(*keys, bin.alias("bin")).agg(*means)


def gap_fill(
    observed: DataFrame,
    keys: list[str],
    values: list[str],
    fill_scope: str = "trial",
    min_bin: int | None = None,
) -> DataFrame:
    """Dense grid of bins per group, every value carried forward from the last bin that has one.

    ``observed`` has one row per group and bin, among them the first and last bin of the grid.  The fill
    needs no join with a grid: each observed bin simply stands until the next one.  With
    ``fill_scope="participant"`` a group without an earlier value takes the last one of the
    participant's previous groups.  ``min_bin`` drops earlier bins *after* filling.
    """
    if fill_scope not in ("trial", "participant"):
        raise ValueError(f"unknown fill_scope {fill_scope!r}")
    rows = blocked(observed.select(*keys, "bin", *values), keys, F.col("bin"))
    order = Window.partitionBy(*keys, "__block").orderBy("bin")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    known = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("bin"))).alias(f"__last_{v}") for v in values]

    def carry(blocks, before, by_block):
        last = {f"__c_{v}": F.last(f"__last_{v}", ignorenulls=True).over(before) for v in values}
        return blocks.withColumns({"__c_then": F.lead("__first").over(by_block), **last})

    linked = carried(rows, keys, [F.min("bin").alias("__first"), *known], carry)
    runs = linked.select(
        *keys,
        "bin",
        *[
            F.coalesce(F.last(v, ignorenulls=True).over(so_far), F.col(f"__c_{v}")).alias(v)
            for v in values
        ],
        F.coalesce(F.lead("bin").over(order), F.col("__c_then")).alias("__next"),
    )
    if fill_scope == "participant":
        runs = _fill_from_previous_trials(runs, rows, keys, values)
    low = F.col("bin") if min_bin is None else F.greatest(F.col("bin"), F.lit(min_bin).cast("long"))
    high = F.coalesce(F.col("__next") - F.lit(1), F.col("bin"))
    kept = runs.withColumns({"__low": low, "__high": high}).filter(F.col("__low") <= F.col("__high"))
    grid = spread(kept, F.col("__low"), F.col("__high"))
    return grid.select(*keys, F.col("__at").alias("bin"), *values)


def _previous_values(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per trial, the last known values of the same participant's earlier trials (in trial order)."""
    known = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("bin"))).alias(v) for v in values]
    trials = rows.groupBy(*keys).agg(*known)
    names = [f"__prior_{v}" for v in values]
    return last_known_before(trials, keys[:-1], keys[-1], values, names).select(*keys, *names)


def _fill_from_previous_trials(
    runs: DataFrame, rows: DataFrame, keys: list[str], values: list[str]
) -> DataFrame:
    prior = _previous_values(rows, keys, values)
    joined = salted_left_join(runs, prior, keys, ["bin"], hot_keys(rows, keys))
    return joined.select(
        *keys, "bin", *[F.coalesce(F.col(v), F.col(f"__prior_{v}")).alias(v) for v in values], "__next"
    )


def resample(
    aligned: DataFrame,
    step: int = STEP_MS,
    fill_scope: str = "trial",
) -> DataFrame:
    """Cursor position on a fixed grid from the referent's onset on.

    The grid of a trial spans all its timed rows, the positions come from its mouse rows only, and bins
    before the onset are dropped after values have been carried forward.
    """
    observed = _observed_bins(aligned.filter(F.col("time").isNotNull()), TRIAL, step)
    grid = gap_fill(observed, TRIAL, ["x", "y"], fill_scope, min_bin=0)
    return grid.withColumn("time", F.col("bin") * F.lit(step))


def _observed_bins(timed: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Mean position of each bin that holds any timed row; null where the mouse rows give none."""
    is_mouse = F.col("event_category") == "mouse"
    n_mouse = F.count_if(is_mouse)
    means = []
    for v in ("x", "y"):
        of_mouse = F.when(is_mouse, F.col(v))
        means.append(F.when(F.count(of_mouse) == n_mouse, F.avg(of_mouse)).alias(v))
    return timed.groupBy(*keys, to_bin("time", step).alias("bin")).agg(*means)


def _left(step: str) -> str:
    """SQL: size of a step when it goes to the left, else 0 (null if unknown)."""
    return f"(CASE WHEN {step} <= 0 THEN -{step} WHEN {step} > 0 THEN 0D END)"


def _right(step: str) -> str:
    return f"(CASE WHEN {step} >= 0 THEN {step} WHEN {step} < 0 THEN 0D END)"


def _scan(rows: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """Carry positions forward and accumulate steps, in ``bin`` order within each group.

    ``rows`` (see ``blocked``) has ``bin``, ``x``, ``y``, ``__counts`` (does a step into this row count?)
    and ``__x0``/``__y0`` (position known before the group starts).  Adds the filled position, the step
    into the row, running totals of steps (all, to the left, to the right), the bin at which a position was
    first known, the next observed bin, and the group's first bin.
    """
    order = f"(PARTITION BY {', '.join(keys)}, __block ORDER BY bin)"
    so_far = order[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    known_bin = "CASE WHEN x IS NOT NULL THEN bin END"

    def columns(df: DataFrame, named: dict[str, str]) -> DataFrame:
        return df.withColumns({name: F.expr(sql) for name, sql in named.items()})

    filled = columns(rows, {f"__in_{v}": f"last({v}, true) OVER {so_far}" for v in ("x", "y")})
    lagged = columns(filled, {"__lag": f"lag(__in_x) OVER {order}"})
    inner = columns(lagged, {"__inner": "CASE WHEN __counts THEN __in_x - __lag END"})
    summary = {
        "__first": "min(bin)",
        "__end_x": "max_by(__in_x, bin)",
        "__end_y": "max_by(__in_y, bin)",
        "__start_x": f"min_by(x, {known_bin})",
        "__start_counts": f"min_by(__counts, {known_bin})",
        "__seen": f"min({known_bin})",
        "__from_x0": "max(__x0)",
        "__s_all": "sum(abs(__inner))",
        "__s_left": f"sum{_left('__inner')}",
        "__s_right": f"sum{_right('__inner')}",
    }

    def carry(blocks: DataFrame, _before, _by_block) -> DataFrame:
        by_block = f"(PARTITION BY {', '.join(keys)} ORDER BY __block)"
        before = by_block[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        linked = columns(
            blocks,
            {
                "__c_x": f"last(__end_x, true) OVER {before}",
                "__c_y": f"last(__end_y, true) OVER {before}",
                "__c_then": f"lead(__first) OVER {by_block}",
                "__c_first": f"min(__first) OVER {before}",
                "__c_seen": f"min(__seen) OVER {before}",
            },
        )
        jump = "CASE WHEN __start_counts THEN __start_x - coalesce(__c_x, __from_x0) END"
        linked = columns(linked, {"__jump": jump})
        jumps = {"all": "abs(__jump)", "left": _left("__jump"), "right": _right("__jump")}
        totals = {
            f"__c_{k}": f"sum(coalesce(__s_{k}, 0D) + coalesce({v}, 0D)) OVER {before}" for k, v in jumps.items()
        }
        return columns(linked, totals)

    linked = carried(inner, keys, [F.expr(sql).alias(n) for n, sql in summary.items()], carry, only)
    at_x, prev = "coalesce(__in_x, __c_x, __x0)", "coalesce(__lag, __c_x, __x0)"
    linked = columns(
        linked,
        {
            "__x": at_x,
            "__y": "coalesce(__in_y, __c_y, __y0)",
            "__step": f"CASE WHEN __counts THEN {at_x} - {prev} END",
            "__next": f"coalesce(lead(bin) OVER {order}, __c_then)",
            "__start": f"coalesce(__c_first, min(bin) OVER {so_far})",
            "__seen": f"coalesce(__c_seen, min({known_bin}) OVER {so_far})",
        },
    )
    steps = {"all": "abs(__step)", "left": _left("__step"), "right": _right("__step")}
    running = {
        f"__{k}": f"sum(coalesce({v}, 0D)) OVER {so_far} + coalesce(__c_{k}, 0D)" for k, v in steps.items()
    }
    return columns(linked, running)


_STEPS = ["distance_travelled", "ldist", "rdist", "ref_dist", "dis_dist"]
_ORIGIN = "greatest(__low, 0L)"
_TOTALS = ["cumulative_distance", "ref_cdist", "dis_cdist", "refprop", "disprop"]


def _row_features(scanned: DataFrame, origin: str) -> DataFrame:
    """Features of the scanned rows, as they hold for a row that is not the first of its grid.

    If no position is known where the grid starts (bin ``origin``), the first steps are unknown and with
    them every running distance of the trial.
    """
    known = f"(coalesce(__seen <= {origin}, false) OR __x0 IS NOT NULL)"

    def sided(to_left: str, to_right: str) -> str:
        return f"CASE WHEN refpos = 'L' THEN {to_left} WHEN refpos <> 'L' THEN {to_right} END"

    def share(part: str) -> str:
        return f"CASE WHEN cumulative_distance = 0 THEN 0D ELSE {part} / cumulative_distance END"

    levels = [
        {
            "distance_travelled": "__step",
            "ldist": _left("__step"),
            "rdist": _right("__step"),
            **{f"__{k}": f"CASE WHEN {known} THEN __{k} END" for k in ("all", "left", "right")},
        },
        {
            "ref_dist": sided("ldist", "rdist"),
            "dis_dist": sided("rdist", "ldist"),
            "cumulative_distance": "__all",
            "ref_cdist": sided("__left", "__right"),
            "dis_cdist": sided("__right", "__left"),
        },
        {"refprop": share("ref_cdist"), "disprop": share("dis_cdist")},
    ]
    for level in levels:
        scanned = scanned.withColumns({name: F.expr(sql) for name, sql in level.items()})
    return scanned


def _grid_features(at: str, origin: str, moving: str = "true") -> list[Column]:
    """Features at grid bin ``at``: 0 at time 0, unknown on a later first row, else those of the row.

    Where not ``moving`` the cursor rests at the row's position, so all steps are 0 if that is known.
    """
    rest = "CASE WHEN __x IS NOT NULL THEN 0D END"

    def placed(value: str) -> str:
        return f"CASE WHEN {at} = 0 THEN 0D WHEN {at} <> {origin} THEN {value} END"

    sql = {"x_step_end": f"CASE WHEN {at} <> {origin} THEN __x END"}
    sql |= {c: placed(c if moving == "true" else f"CASE WHEN {moving} THEN {c} ELSE {rest} END") for c in _STEPS}
    sql |= {c: placed(c) for c in _TOTALS}
    return [F.expr(sql[name]).alias(name) for name in FEATURES]


def movement_features(binned: DataFrame, keys: list[str] = TRIAL) -> DataFrame:
    """Steps and cumulative distances towards referent and distractor on a gap-filled grid.

    ``binned`` has one row per trial and bin with ``x``, ``y`` and ``refpos``, the referent's side.
    """
    nothing = F.lit(None).cast("double")
    rows = blocked(binned, keys, F.col("bin")).withColumns(
        {"__counts": F.lit(True), "__x0": nothing, "__y0": nothing}
    )
    featured = _row_features(_scan(rows, keys), "__start")
    return featured.select(*binned.columns, *_grid_features("bin", "__start"))


def _grid_spans(events: DataFrame, durations: DataFrame, step: int) -> DataFrame:
    """One row per trial: end of its first audio, and first and last bin of its grid."""
    return trial_clock(events, durations).select(
        *TRIAL,
        "condition",
        "refpos",
        "audio1_end",
        to_bin(F.col("first_elapsed") - F.col("audio1_end"), step).alias("__low"),
        to_bin(F.col("last_elapsed") - F.col("audio1_end"), step).alias("__high"),
    )


def heavy_grids(events: DataFrame, durations: DataFrame, step: int = STEP_MS) -> DataFrame:
    """Trials with a very long grid, for joins on resampled data; known without resampling anything."""
    sizes = F.expr("__high - greatest(__low, 0L) + 1")
    return heaviest(_grid_spans(events, durations, step).select(*TRIAL, sizes.alias("__rows")), TRIAL)


def grid_spans(events: DataFrame, durations: DataFrame, step: int = STEP_MS) -> DataFrame:
    """One row per trial that has a grid: condition, referent side, and the first and last kept bin."""
    spans = _grid_spans(events, durations, step).select(
        *TRIAL, "condition", "refpos", F.expr("greatest(__low, 0L)").alias("low"), F.col("__high").alias("high")
    )
    known = F.col("participant").isNotNull() & F.col("trial").isNotNull()
    return spans.filter(known & (F.col("low") <= F.col("high")))


def steady_runs(
    events: DataFrame, durations: DataFrame, step: int = STEP_MS, fill_scope: str = "trial"
) -> DataFrame:
    """The rows of ``trajectories`` as stretches of bins (``low..high``) in which position and totals stay the same.

    Steps into a bin are left out, as they belong to the first bin of a stretch only.
    """
    head = F.expr("struct(__at_low AS low, __at_low AS high, true AS first)")
    tail = F.expr("struct(__at_low + 1 AS low, __at_high AS high, false AS first)")
    whole = F.expr("struct(__at_low AS low, __at_high AS high, false AS first)")
    begins = F.expr(f"__at_low = {_ORIGIN}")
    pieces = F.when(begins & F.expr("__at_low < __at_high"), F.array(head, tail)).when(begins, F.array(head))
    runs = _runs(events, durations, step, fill_scope)
    cut = runs.select(*TRIAL, "condition", "refpos", "__x", "__y", *_TOTALS, F.inline(pieces.otherwise(F.array(whole))))
    at_first = F.when(F.col("low") == 0, F.lit(0.0))
    totals = [F.when(F.col("first"), at_first).otherwise(F.col(c)).alias(c) for c in _TOTALS]
    return cut.select(
        *TRIAL, "condition", "refpos", "low", "high", F.col("__x").alias("x"), F.col("__y").alias("y"), *totals
    )


def trajectories(
    events: DataFrame,
    durations: DataFrame,
    step: int = STEP_MS,
    fill_scope: str = "trial",
) -> DataFrame:
    """Onset-aligned, resampled trials with movement features, straight from raw events.

    Equal to aligning, resampling and ``movement_features`` in turn.  Plan: one narrow aggregate gives each
    trial's clock; events meet their clock in one join (heavy trials spread over sub-keys) and collapse to
    bin sums in place; the bins are shuffled once by trial block, where all window work happens on the
    observed bins; only then is each observed bin spread over the grid.
    """
    grid = spread(_runs(events, durations, step, fill_scope), F.col("__at_low"), F.col("__at_high"))
    return grid.select(
        *TRIAL,
        "condition",
        "refpos",
        F.col("__at").alias("bin"),
        (F.col("__at") * F.lit(step)).alias("time"),
        F.col("__x").alias("x"),
        F.col("__y").alias("y"),
        *_grid_features("__at", _ORIGIN, "__at = __at_low"),
    )


def _runs(events: DataFrame, durations: DataFrame, step: int, fill_scope: str) -> DataFrame:
    """Observed bins with features, each with the bins of the kept grid (``__at_low..__at_high``) it stands for."""
    if fill_scope not in ("trial", "participant"):
        raise ValueError(f"unknown fill_scope {fill_scope!r}")
    constant = ["condition", "refpos"]
    events = events.filter(F.col("participant").isNotNull() & F.col("trial").isNotNull())
    clock = _grid_spans(events, durations, step)
    samples = events.select(*TRIAL, "seq", "event_category", "elapsed", "x", "y")
    timed = salted_left_join(
        samples, clock, TRIAL, ["seq"], hot_keys(events, TRIAL), keep_slice=True
    ).withColumn("time", F.col("elapsed") - F.col("audio1_end"))
    timed = timed.filter(F.col("time").isNotNull()).withColumn("bin", to_bin("time", step))

    is_mouse = F.col("event_category") == "mouse"
    parts = [F.count_if(is_mouse).alias("__n")]
    for v in ("x", "y"):
        of_mouse = F.when(is_mouse, F.col(v))
        parts += [F.sum(of_mouse).alias(f"__sum_{v}"), F.count(of_mouse).alias(f"__n_{v}")]
    group = [*TRIAL, *constant, "__low"]
    # bins of a sub-key are summed where the join left them, so a heavy bin crosses the network as a few rows
    partial = timed.groupBy(*group, "__high", "__slice", "bin").agg(*parts)
    placed = blocked(partial, TRIAL, F.col("bin") - F.col("__low"))
    means = [
        F.when(F.sum(f"__n_{v}") == F.sum("__n"), F.sum(f"__sum_{v}") / F.sum(f"__n_{v}")).alias(v)
        for v in ("x", "y")
    ]
    observed = placed.groupBy(*group, "__block", "bin").agg(*means, F.max("__high").alias("__high"))

    nothing = F.lit(None).cast("double")
    rows = observed.withColumn("__counts", F.expr(f"bin > {_ORIGIN}"))
    if fill_scope == "participant":
        prior = _previous_values(observed, TRIAL, ["x", "y"])
        prior = prior.withColumnsRenamed({"__prior_x": "__x0", "__prior_y": "__y0"})
        rows = salted_left_join(rows, prior, TRIAL, ["bin"], hot_keys(observed, TRIAL))
    else:
        rows = rows.withColumns({"__x0": nothing, "__y0": nothing})
    scanned = _scan(rows, TRIAL, only=block_of(F.col("__high") - F.col("__low")) > 0)

    return _row_features(scanned, _ORIGIN).withColumns(
        {
            "__at_low": F.expr(f"greatest(bin, {_ORIGIN})"),
            "__at_high": F.expr("coalesce(__next - 1, __high)"),
        }
    ).filter("__at_low <= __at_high")

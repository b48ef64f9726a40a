"""Summaries: time courses, frequency tables and the report tables of the analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions import chi_square_p, if_else, strict_avg
from tracelane.operators.intervals import running_totals, spread
from tracelane.operators.joins import natural_join
from tracelane.operators.skew import attach_group_facts, blocked, carried, heaviest, range_blocks


def to_long(
    df: DataFrame, ids: list[str], measures: list[str], key: str = "AOI", value: str = "prop"
) -> DataFrame:
    """One row per original row and measure column."""
    return df.unpivot(ids, measures, key, value)


def _mean(c: Column | str, na: str) -> Column:
    if na == "propagate":
        return strict_avg(c)
    if na == "skip":
        return F.avg(c)
    raise ValueError(f"unknown na rule {na!r}")


def _with_interval(long: DataFrame, bin: str, interval: float) -> DataFrame:
    return long.withColumns(
        {
            "low": F.col("mean_prop") - F.col("se"),
            "up": F.col("mean_prop") + F.col("se"),
            "time": F.col(bin) * F.lit(interval),
        }
    )


def _stack(wide: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """The (mean, se) pair of every measure as a row of its own; runs on the small final table."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("AOI"),
                F.col(f"__mean_{i}").alias("mean_prop"),
                F.col(f"__se_{i}").alias("se"),
            )
            for i, m in enumerate(measures)
        ]
    )
    return wide.select(*ids, F.inline(rows))


def timecourse(
    df: DataFrame,
    aois: list[str],
    subject: str,
    by: list[str],
    bin: str = "bin",
    interval: float = 20,
    na: str = "propagate",
) -> DataFrame:
    """Mean and by-subject standard error of each measure per condition cell and time bin.

    Measures are averaged within subject first.  Both levels aggregate all measures side by side (each row
    is read and shuffled once, whatever the number of measures) and only the result is turned long.
    """
    cell = [*by, bin]
    subjects = df.groupBy(subject, *cell).agg(*[_mean(m, na).alias(f"__m_{i}") for i, m in enumerate(aois)])
    out = []
    for i in range(len(aois)):
        m = F.col(f"__m_{i}")
        n = F.count(F.lit(1)) if na == "propagate" else F.count(m)
        se = F.stddev_samp(m) / F.sqrt(n)
        complete = F.count(m) == F.count(F.lit(1))
        out += [
            _mean(m, na).alias(f"__mean_{i}"),
            (F.when(complete, se) if na == "propagate" else se).alias(f"__se_{i}"),
        ]
    wide = subjects.groupBy(*cell).agg(*out)
    return _with_interval(_stack(wide, cell, aois), bin, interval)


def timecourse_of_runs(
    runs: DataFrame,
    aois: list[str],
    subject: str,
    by: list[str],
    interval: float = 20,
    na: str = "propagate",
) -> DataFrame:
    """``timecourse`` of rows that hold for a stretch of bins (``low..high``), without spreading them.

    Two sweeps along the bins: one adds up each subject's rows per cell, the other the subjects' means and their
    squares per cell; between two changes nothing has to be looked at.  Only the curves themselves are spread over
    the bins.  The error comes from sums of squares, so values should not be far from 0 for their spread.
    """
    if na not in ("propagate", "skip"):
        raise ValueError(f"unknown na rule {na!r}")
    one, whole = F.lit(1).cast("long"), na == "propagate"
    sums = {"__n": one}
    for i, m in enumerate(aois):
        sums[f"__k_{i}"] = F.col(m).isNotNull().cast("long")
        sums[f"__s_{i}"] = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
    own = running_totals(runs, [subject, *by], sums).filter(F.col("__n") > 0)
    sums = {"__n": one}
    for i in range(len(aois)):
        known, total = F.col(f"__k_{i}"), F.col(f"__s_{i}")
        m = F.when(known == F.col("__n") if whole else known > 0, total / known)
        sums[f"__k_{i}"] = m.isNotNull().cast("long")
        sums[f"__s_{i}"] = F.coalesce(m, F.lit(0.0))
        sums[f"__q_{i}"] = F.coalesce(m * m, F.lit(0.0))
    cells = running_totals(own, by, sums).filter(F.col("__n") > 0)
    return _curves(cells, by, aois, interval, whole)


def _curves(cells: DataFrame, by: list[str], names: list[str], interval: float, whole: bool) -> DataFrame:
    """Mean and error per bin from counts (``__n``; known ``__k_i``), sums and sums of squares of each measure."""
    out = {}
    for i in range(len(names)):
        k, s, q = (F.col(f"__{c}_{i}") for c in "ksq")
        known = k == F.col("__n") if whole else k > 0
        spread_of = F.greatest(q - s * s / k, F.lit(0.0)) / (k - F.lit(1))
        out[f"__mean_{i}"] = F.when(known, s / k)
        out[f"__se_{i}"] = F.when(known & (k > 1), F.sqrt(spread_of) / F.sqrt(k))
    wide = cells.select(*by, "low", "high", *[c.alias(n) for n, c in out.items()])
    bins = spread(wide, F.col("low"), F.col("high")).withColumnRenamed("__at", "bin")
    return _with_interval(_stack(bins, [*by, "bin"], names), "bin", interval)


def timecourse_rows(
    df: DataFrame, aois: list[str], by: list[str], bin: str = "bin", interval: float = 20
) -> DataFrame:
    """Time course with mean and standard error over rows instead of over subjects.

    As in the older helper, a missing value makes the mean unknown while the error skips it, and rows without a
    bin or condition belong to no curve.
    """
    cell = [bin, *by]
    df = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell]))
    out = []
    for i, m in enumerate(aois):
        out += [
            strict_avg(m).alias(f"__mean_{i}"),
            (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"__se_{i}"),
        ]
    wide = df.groupBy(*cell).agg(*out)
    return _with_interval(_stack(wide, cell, aois), bin, interval)


def with_empty_cells(counts: DataFrame, cols: list[str], within: list[str] | None = None, n: str = "n") -> DataFrame:
    """Counted level combinations and, with count 0, those that do not occur.

    Each column's levels are those that occur (per group of ``within``); the grid of combinations grows column by
    column from the lists of levels, so nothing larger than the complete table is built.
    """
    within = within or []
    levels = counts.groupBy(*within).agg(*[F.collect_set(c).alias(f"__all_{c}") for c in cols])
    grid = levels
    for c in cols:
        grid = grid.withColumn(c, F.explode(f"__all_{c}")).drop(f"__all_{c}")
    rest = [c for c in counts.columns if c not in (*within, *cols, n)]
    return grid.join(counts, [*within, *cols], "left").select(
        *within, *cols, F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n), *rest
    )


def freq_table(df: DataFrame, cols: list[str], margin: list[str] | None = None) -> DataFrame:
    """Counts per level combination with proportions of the whole, or of the ``margin`` columns' rows.

    As in a contingency table a null level is left out, and combinations that do not occur have the count 0; their
    margin may be empty, and then has no proportions.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    counts = df.filter(present).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if margin:
        total = F.sum("n").over(Window.partitionBy(*margin))
    else:
        total = counts.agg(F.sum("n").alias("total")).scalar()
    whole = with_empty_cells(counts, cols) if len(cols) > 1 else counts
    return whole.withColumn("prop", F.col("n") / F.nullif(total, F.lit(0)))


def strat_table(
    df: DataFrame, strata: str | None, variables: list[str], test: bool = True
) -> DataFrame:
    """Count, percentage and chi-square test of each categorical variable by stratum.

    One pass over the rows: all variables are counted together in long form.  A level that a stratum lacks has the
    count 0 there.  2x2 tables get the continuity correction.  Without ``strata`` the table has a single ``Overall``
    stratum and no test.
    """
    stratum = F.lit("Overall") if strata is None else F.col(strata).cast("string")
    slim = df.select(
        stratum.alias("stratum"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
                    for v in variables
                ]
            )
        ),
    )
    cells = slim.filter(F.col("level").isNotNull() & F.col("stratum").isNotNull())
    cells = cells.groupBy("variable", "level", "stratum").agg(F.count(F.lit(1)).alias("n"))
    cells = with_empty_cells(cells, ["level", "stratum"], ["variable"])
    column = F.sum("n").over(Window.partitionBy("variable", "stratum"))
    table = cells.withColumn("percent", F.lit(100.0) * F.col("n") / column)
    return table if strata is None or not test else with_chi_square(table)


def with_chi_square(cells: DataFrame) -> DataFrame:
    """Add chi-square statistic, degrees of freedom and p value of each variable to (variable, level, stratum, n).

    Works on the counted cells, with or without the empty ones: the plain statistic is
    total * (sum of n^2 / (row * column) - 1), to which an empty cell adds nothing.  In a 2x2 table all cells
    miss their expectation by the same amount, so the corrected form follows from any filled cell.
    """
    row, col = Window.partitionBy("variable", "level"), Window.partitionBy("variable", "stratum")
    whole = Window.partitionBy("variable")
    n = F.col("n").cast("double")  # products of counts exceed a long
    one = F.lit(1.0)
    margins = cells.withColumns(
        {
            "__row": F.sum(n).over(row),
            "__in_row": F.count(n).over(row),
            "__col": F.sum(n).over(col),
            "__in_col": F.count(n).over(col),
            "__total": F.sum(n).over(whole),
        }
    )
    gap = F.abs(n - F.col("__row") * F.col("__col") / F.col("__total"))
    sums = margins.withColumns(
        {
            "__terms": F.sum(n * n / (F.col("__row") * F.col("__col"))).over(whole),
            "__rows": F.round(F.sum(one / F.col("__in_row")).over(whole)).cast("long"),
            "__cols": F.round(F.sum(one / F.col("__in_col")).over(whole)).cast("long"),
            "__row_inv": F.sum(one / (F.col("__row") * F.col("__in_row"))).over(whole),
            "__col_inv": F.sum(one / (F.col("__col") * F.col("__in_col"))).over(whole),
            "__gap": F.max(gap).over(whole),
        }
    )
    dof = (F.col("__rows") - 1) * (F.col("__cols") - 1)
    less = F.col("__gap") - F.least(F.lit(0.5), F.col("__gap"))
    corrected = less * less * F.col("__total") * F.col("__row_inv") * F.col("__col_inv")
    plain = F.col("__total") * (F.col("__terms") - one)
    two_by_two = (F.col("__rows") == 2) & (F.col("__cols") == 2)
    statistic = F.when(dof > 0, F.when(two_by_two, corrected).otherwise(plain))
    tested = sums.select(*cells.columns, statistic.alias("chi_square"), dof.alias("dof"))
    return tested.withColumn("p", chi_square_p("chi_square", "dof"))


def invalidity_breakdown(trials: DataFrame, min_click_ms: float = 200) -> DataFrame:
    """Number of trials per cohort and combination of the four validity reasons."""
    late = F.coalesce(F.col("clicktime") >= F.lit(min_click_ms), F.lit(False))
    flags = {
        "rtval": F.when(late, 1).otherwise(0),
        "clickval": if_else(F.col("clicked") != "none", F.lit(1), F.lit(0)),
        "datapoints": if_else(F.col("datapoints") != 0, F.lit(1), F.lit(0)),
        "audio": if_else(F.col("audio_played") == 1, F.lit(1), F.lit(0)),
    }
    flagged = trials.select("cohort", *[c.alias(name) for name, c in flags.items()])
    return flagged.groupBy("cohort", *flags).agg(F.count(F.lit(1)).alias("n"))


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Median of the known values of each group, by rank, with no group's values in one task.

    Equal values are counted first; the counts are cut into ranges of the sorted values, whose sizes tell which one or
    two ranges hold the middle ranks, and only in these are the values counted off.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v"))
    blocks = range_blocks(counts.agg(F.count(F.lit(1)).alias("__n")), [*by, "__v"])
    sizes = blocks.groupBy(*by, "__block").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*by)
    before = F.sum("__size").over(group.orderBy("__block")) - F.col("__size")
    total = F.sum("__size").over(group)
    sizes = sizes.select(*by, "__block", "__size", before.alias("__before"), total.alias("__total"))
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor((F.col("__total") + 2) / 2)
    middle = sizes.withColumns({"__low": low, "__high": high}).filter(
        (F.col("__before") < F.col("__high")) & (F.col("__before") + F.col("__size") >= F.col("__low"))
    )
    near = natural_join(blocks, middle, "inner", [*by, "__block"])
    so_far = Window.partitionBy(*by, "__block").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("__before") + F.sum("__n").over(so_far)
    ranked = near.withColumn("__last", last)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("__last") >= F.col(rank)) & (F.col("__last") - F.col("__n") < F.col(rank)), F.col("__v")))

    return ranked.groupBy(*by).agg(((at("__low") + at("__high")) / F.lit(2)).alias(name))


def time_taken(ppt: DataFrame, by: list[str]) -> DataFrame:
    """Median, shortest and longest duration (minutes) per cohort; unknown if any is unknown."""
    t = F.col("time_taken")
    ends = ppt.groupBy(*by).agg(
        (F.count(t) == F.count(F.lit(1))).alias("__whole"), F.min(t).alias("min_time"), F.max(t).alias("max_time")
    )
    both = natural_join(ends, exact_median(ppt, by, "time_taken", "med_time"), "left", by)
    return both.select(*by, *[F.when(F.col("__whole"), F.col(c)).alias(c) for c in ("med_time", "min_time", "max_time")])


def hour_histogram(ppt: DataFrame, by: list[str], start: str = "first_time1") -> DataFrame:
    """Participants per starting hour of the day."""
    return (
        ppt.withColumn("hourstart", F.hour(start))
        .filter(F.col("hourstart").isNotNull())
        .groupBy(*by, "hourstart")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def choice_summary(clicks: DataFrame, seq: str | None = None) -> DataFrame:
    """Share of referent choices and mean reaction time per condition, one vote per trial."""
    order = seq or "trial"
    trials = clicks.groupBy("participant", "trial").agg(
        F.min_by("clicked", order).alias("clicked"),
        F.min_by("condition", order).alias("condition"),
        F.min_by("clicktime", order).alias("rt"),
    )
    is_ref = F.col("clicked") == "ref"
    return trials.groupBy("condition").agg(
        F.when(F.count("clicked") == F.count(F.lit(1)), F.count_if(is_ref) / F.count(F.lit(1))).alias(
            "refclicks"
        ),
        F.avg("rt").alias("mean_rt"),
    )


def attempts(roster: DataFrame, min_attempts: int = 2, batch_prefix: str = "") -> DataFrame:
    """The submissions of workers with several, in order: one row each, with its ``position`` and their number.

    ``batch_prefix`` is left out of the batch names.  A worker with a heavy share of all rows is numbered in
    slices of ``seq``, which follow one another; the rows are the same at every size.
    """
    worker = ["mturk_id"]
    counts = roster.groupBy(*worker).agg(
        F.count(F.lit(1)).alias("__rows"), F.min("seq").alias("__from"), F.max("seq").alias("__to")
    )
    heavy = heaviest(counts, worker, also=("__from", "__to"))
    heavy = F.broadcast(heavy.withColumnRenamed("mturk_id", "__worker"))
    marked = roster.join(heavy, roster["mturk_id"].eqNullSafe(heavy["__worker"]), "left")
    cut = F.floor((F.col("seq") - F.col("__from")) * F.col("__slices") / (F.col("__to") - F.col("__from") + 1))
    parts = marked.select(*roster.columns, F.coalesce(cut.cast("int"), F.lit(0)).alias("__part"))
    slices = Window.partitionBy(*worker)
    sizes = parts.groupBy(*worker, "__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(
        *worker,
        "__part",
        (F.sum("__n").over(slices.orderBy("__part")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(slices).alias("nr_attempts"),
    ).filter(F.col("nr_attempts") >= min_attempts)
    own = F.row_number().over(Window.partitionBy(*worker, "__part").orderBy("seq"))
    numbered = natural_join(parts.withColumn("__own", own), sizes, "inner", [*worker, "__part"])
    return numbered.select(
        *worker,
        (F.col("__before") + F.col("__own")).alias("position"),
        "nr_attempts",
        F.replace("batch", F.lit(batch_prefix), F.lit("")).alias("batch") if batch_prefix else F.col("batch"),
        "comments",
    )


def listed_attempts(roster: DataFrame) -> DataFrame:
    """All submissions of each worker in order (see ``attempts``)."""
    return attempts(roster, min_attempts=1).select("mturk_id", "position", "batch")


def has_duplicates(df: DataFrame, col: str) -> DataFrame:
    """One row telling whether any value of ``col`` occurs twice (null counts as a value)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("any_duplicate"))


def mark_duplicates(df: DataFrame, col: str, seq: str, name: str = "duplicate") -> DataFrame:
    """True for every occurrence of a value after its first; nulls are duplicates of each other."""
    first = attach_group_facts(df, [col], [F.min(seq).alias("__first")], [seq])
    return first.withColumn(name, F.col(seq) > F.col("__first")).drop("__first")


def zscore(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Standardise over all rows; both moments come as one scalar struct, not through a global window."""
    moments = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")).alias("s")).scalar()
    spread = F.nullif(moments["sd"], F.lit(0.0))
    return df.withColumn(name or f"{col}_z", (F.col(col) - moments["mean"]) / spread)


def series_start(df: DataFrame, keys: list[str], order: str, name: str = "start_event") -> DataFrame:
    """True on the first row of each series."""
    marked = attach_group_facts(df, keys, [F.min(order).alias("__first")], [order])
    return marked.withColumn(name, F.col(order) == F.col("__first")).drop("__first")


def lag1_autocorr(df: DataFrame, keys: list[str], order: str, col: str, size: int | None = None) -> DataFrame:
    """Correlation of each value with its predecessor, per series; ``order`` is an integer column."""
    rows = blocked(df.select(*keys, order, col), keys, F.col(order), size)
    w = Window.partitionBy(*keys, "__block").orderBy(order)

    def carry(blocks, before, by_block):
        return blocks.withColumn("__c_prev", F.lag("__end").over(by_block))

    linked = carried(rows, keys, [F.max_by(col, order).alias("__end")], carry)
    first_of_block = F.row_number().over(w) == 1
    prev = F.when(first_of_block, F.col("__c_prev")).otherwise(F.lag(col).over(w))
    pairs = linked.select(*keys, F.col(col).cast("double").alias("__a"), prev.cast("double").alias("__b"))
    return pairs.groupBy(*keys).agg(_correlation("__a", "__b").alias("autocorr"))


def _correlation(a: str, b: str) -> Column:
    """Correlation over complete pairs; null (not an error) when one side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def step_features(
    df: DataFrame, keys: list[str], order: str, x: str, size: int | None = None, sparse: bool = False
) -> DataFrame:
    """Signed step to the previous row, and the running sum of absolute steps, per group.

    ``order`` is an integer column, whose places are cut into blocks.  ``sparse`` is for keys with far more places
    than rows, such as the global number of an event, and for any other type: rows are then cut into evenly filled
    ranges, so that there are few blocks however far apart a group's rows lie.  The first row of a group has neither
    value; an unknown step makes all later running sums unknown.
    """
    rows = range_blocks(df, [*keys, order]) if sparse else blocked(df, keys, F.col(order), size)
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({"__lag": F.lag(x).over(w), "__nth": F.row_number().over(w)}).withColumn(
        "__d", F.abs(F.col(x) - F.col("__lag"))
    )
    later = F.col("__nth") > 1
    summary = [
        F.max_by(x, order).alias("__end"),
        F.min_by(x, order).alias("__start"),
        F.sum("__d").alias("__sum"),
        F.count_if(later & F.col("__d").isNull()).alias("__bad"),
    ]

    def carry(blocks, before, by_block):
        came = F.lag("__end").over(by_block)
        has_previous = F.lag("__block").over(by_block).isNotNull()
        linked = blocks.withColumns(
            {"__c_prev": came, "__c_any": has_previous, "__jump": F.abs(F.col("__start") - came)}
        )
        total = F.coalesce(F.col("__sum"), F.lit(0.0)) + F.coalesce(F.col("__jump"), F.lit(0.0))
        bad = F.col("__bad") + F.when(F.col("__c_any") & F.col("__jump").isNull(), 1).otherwise(0)
        return linked.withColumns(
            {"__c_sum": F.sum(total).over(before), "__c_bad": F.sum(bad).over(before)}
        )

    linked = carried(inner, keys, summary, carry)
    has_previous = later | F.coalesce(F.col("__c_any"), F.lit(False))
    prev = F.when(later, F.col("__lag")).otherwise(F.col("__c_prev"))
    stepped = linked.withColumns({"step": F.col(x) - prev, "__follows": has_previous})
    run = F.sum(F.coalesce(F.abs("step"), F.lit(0.0))).over(so_far) + F.coalesce(F.col("__c_sum"), F.lit(0.0))
    bad = F.count_if(F.col("__follows") & F.col("step").isNull()).over(so_far)
    bad = bad + F.coalesce(F.col("__c_bad"), F.lit(0))
    return stepped.select(
        *df.columns, "step", F.when(F.col("__follows") & (bad == 0), run).alias("cumulative")
    )


def first_index(df: DataFrame, keys: list[str], cond: Column, seq: str, value: str) -> DataFrame:
    """Per group, 1-based position of the first row (in ``seq`` order) that meets ``cond``, and its value.

    The position is one more than the number of rows ahead of the match, which needs counting only.
    """
    match = F.min(F.when(cond, F.col(seq))).alias("__at")
    marked = attach_group_facts(df, keys, [match], [seq])
    ahead = F.count_if(F.col(seq) < F.col("__at")) + 1
    return marked.groupBy(*keys).agg(
        F.when(F.count("__at") > 0, ahead).alias("first_index"),
        F.min_by(value, F.when(F.col(seq) == F.col("__at"), F.col(seq))).alias("first_value"),
    )

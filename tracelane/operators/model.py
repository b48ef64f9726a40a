"""The data frame behind the statistical models, and table-form estimates.

Spark has no mixed-model solver.  ``subject_slopes`` (two-stage growth curve) and ``choice_logit`` (fixed
effects only) answer the same questions with different, documented estimators.

The frame exists in two forms: rows of the grid (``model_frame``), and stretches of bins with steady totals
(``model_runs``), on which the estimates are sums in closed form and the grid is never spread.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions import code_values, elog, level_code, matches, move_category
from tracelane.operators.aggregate import _curves, _mean, _stack, _with_interval, zscore
from tracelane.operators.intervals import running_totals, spread, sum_of_places, sum_of_squares
from tracelane.operators.skew import checkpointed, salted_left_join

# fixed values: contrast of the condition, order of the movement categories
FLUENCY_CODES = {"Fluent": -0.5, "Disfluent": 0.5}
MOVES = ["dist", "neither", "ref"]


def bias_columns(df: DataFrame, mode: str = "as_written") -> DataFrame:
    """Empirical-logit bias and movement category (also as a number) from the two proportions."""
    move = move_category("refprop", "disprop")
    relog, delog = elog("refprop", 1, mode), elog("disprop", 1, mode)
    return df.withColumns(
        {
            "relog": relog,
            "delog": delog,
            "elog_bias": relog - delog,
            "move": move,
            "moveo": level_code(move, MOVES),
        }
    )


def chosen_rows() -> Column:
    """True for rows of valid trials of valid, first-time, monolingual participants."""
    return (
        (F.col("include_ppt") == "valid")
        & (F.col("include_trial") == "valid")
        & (F.col("duplicate2") == "n-dup")
        & matches("bilingual", "No")
    )


def model_frame(
    binned: DataFrame,
    max_seconds: float = 2.0,
    mode: str = "as_written",
    codes: dict[str, float] = FLUENCY_CODES,
) -> DataFrame:
    """Rows and columns the growth-curve model is fitted on, from grid rows with all attributes.

    Time is standardised over the whole selected data *before* late rows are dropped, so ``binned`` is read twice;
    it should be a stored table.
    """
    needed = ["participant", "trial", "condition", "cohort", "bin", "time", "refprop", "disprop"]
    chosen = binned.filter(chosen_rows()).select(*[c for c in needed if c in binned.columns])
    timed = chosen.withColumn("time_s", F.col("time") / F.lit(1000.0))
    named = zscore(timed, "time_s", "time_z").filter(F.col("time_s") <= max_seconds)
    framed = bias_columns(named, mode).withColumn("fluency_c", code_values("condition", codes))
    return framed.withColumnsRenamed(_NAMES)


_NAMES = {"participant": "sub", "trial": "ref", "condition": "fluency"}


def bin_moments(spans: DataFrame) -> Column:
    """``n, mean, sd`` of the bins of all spans (``low..high``) as one scalar, in closed form."""
    low, high = F.col("low"), F.col("high")
    sums = spans.agg(
        F.sum(high - low + 1).cast("decimal(18,0)").alias("n"),
        F.sum(sum_of_places(low, high)).cast("double").alias("s"),
        F.sum(sum_of_squares(low, high)).cast("double").alias("q"),
    )
    n, s, q = F.col("n").cast("double"), F.col("s"), F.col("q")
    deviation = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
    return sums.select(F.struct(n.alias("n"), (s / n).alias("mean"), deviation.alias("sd")).alias("m")).scalar()


def standardised(bin: str | Column, moments: Column) -> Column:
    """z-score of a bin (and so of its time) by ``bin_moments``."""
    bin = F.col(bin) if isinstance(bin, str) else bin
    return (bin - moments["mean"]) / F.nullif(moments["sd"], F.lit(0.0))


def model_runs(
    runs: DataFrame,
    spans: DataFrame,
    step: int,
    max_seconds: float = 2.0,
    mode: str = "as_written",
    codes: dict[str, float] = FLUENCY_CODES,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The model's rows as stretches of bins: ``sub, ref, fluency, cohort, low, high`` and the bias columns.

    ``spans`` are the chosen trials (participant, trial, cohort), ``runs`` the steady stretches of all.  Late bins
    are cut off the stretches.  ``hot`` may give the trials that are heavy in ``runs``.
    """
    trial = ["participant", "trial"]
    marks = spans.select(*trial, "cohort", F.lit(True).alias("__chosen"))
    kept = salted_left_join(runs, marks, trial, ["low"], hot).filter("__chosen")
    last = F.lit(int(max_seconds * 1000 // step)).cast("long")
    cut = kept.withColumn("high", F.least("high", last)).filter(F.col("low") <= F.col("high"))
    framed = bias_columns(cut, mode).withColumn("fluency_c", code_values("condition", codes))
    return framed.withColumnsRenamed(_NAMES)


def frame_of_runs(runs: DataFrame, moments: Column, step: int) -> DataFrame:
    """``model_runs`` spread over the grid, with time in seconds and standardised."""
    rows = spread(runs, F.col("low"), F.col("high")).withColumnRenamed("__at", "bin")
    seconds = F.col("bin") * F.lit(step) / F.lit(1000.0)
    return rows.withColumns({"time_s": seconds, "time_z": standardised("bin", moments)}).drop("low", "high", "__from")


def _line(n: Column, x: Column, xx: Column, y: Column, xy: Column, several: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept from sums; null unless there are several places."""
    slope = F.when(several, (n * xy - x * y) / (n * xx - x * x))
    return slope, (y - slope * x) / n


def slopes_of_runs(runs: DataFrame, y: str, by: list[str], moments: Column, subject: str = "sub") -> DataFrame:
    """``subject_slopes`` of ``y`` on standardised time from stretches of bins.

    A stretch adds its number of bins, their sum and the sum of their squares, and the first two times ``y``.  The
    line is fitted on bins; the moments only turn it.
    """
    low, high, v = F.col("low"), F.col("high"), F.col(y).cast("double")
    size, places = high - low + 1, sum_of_places(low, high).cast("double")

    def total(c: Column) -> Column:
        return F.sum(F.when(v.isNotNull(), c))

    sums = runs.groupBy(subject, *by).agg(
        F.coalesce(total(size), F.lit(0)).cast("long").alias("n"),
        total(places).alias("__x"),
        total(sum_of_squares(low, high)).cast("double").alias("__xx"),
        total(size * v).alias("__y"),
        total(places * v).alias("__xy"),
        (F.min(F.when(v.isNotNull(), low)) < F.max(F.when(v.isNotNull(), high))).alias("__several"),
    )
    slope, intercept = _line(*[F.col(c) for c in ("n", "__x", "__xx", "__y", "__xy", "__several")])
    lines = sums.select(subject, *by, slope.alias("__slope"), intercept.alias("__at_0"), "n", moments.alias("__m"))
    return lines.select(
        subject,
        *by,
        (F.col("__slope") * F.col("__m.sd")).alias("slope"),
        (F.col("__at_0") + F.col("__slope") * F.col("__m.mean")).alias("intercept"),
        "n",
    )


def fitted_of_runs(
    runs: DataFrame, by: list[str], y: str = "elog_bias", subject: str = "sub", interval: float = 20
) -> DataFrame:
    """Observed and fitted time courses (``fitted_timecourse``, each subject's line fitted here) from stretches of bins.

    A first sweep adds up each subject's rows; the line comes from the same stretches.  Where the same subjects are
    present, the mean of their lines is a line and its variance a parabola: the second sweep adds up intercepts,
    slopes, their squares and products, and the bin enters only where the curves are spread.  A line fitted on
    standardised time has the same values.
    """
    one, v = F.lit(1).cast("long"), F.col(y).cast("double")
    sums = {"__n": one, "__k": v.isNotNull().cast("long"), "__s": F.coalesce(v, F.lit(0.0))}
    own = running_totals(runs, [subject, *by], sums).filter(F.col("__n") > 0)
    whole = Window.partitionBy(subject, *by)
    low, high, k, s = F.col("low"), F.col("high"), F.col("__k"), F.col("__s")
    places = sum_of_places(low, high).cast("double")
    parts = {
        "__c": k * (high - low + 1),
        "__x": k * places,
        "__xx": k * sum_of_squares(low, high).cast("double"),
        "__y": F.when(k > 0, s * (high - low + 1)),
        "__xy": F.when(k > 0, s * places),
    }
    totals = {name: F.sum(c).over(whole) for name, c in parts.items()}
    known = k > 0
    totals["__several"] = F.min(F.when(known, low)).over(whole) < F.max(F.when(known, high)).over(whole)
    b, a = _line(*[F.col(c) for c in totals])
    curves = own.withColumns(totals).select(
        *by,
        "low",
        "high",
        F.when(F.col("__k") == F.col("__n"), F.col("__s") / F.col("__n")).alias("__m"),
        a.alias("__a"),
        b.alias("__b"),
    )
    m, a, b = F.col("__m"), F.col("__a"), F.col("__b")
    sums = {"__n": one, "__k_0": m.isNotNull().cast("long"), "__k_1": b.isNotNull().cast("long")}
    values = {"__s_0": m, "__q_0": m * m, "__a": a, "__b": b, "__aa": a * a, "__ab": a * b, "__bb": b * b}
    sums |= {name: F.coalesce(c, F.lit(0.0)) for name, c in values.items()}
    cells = running_totals(curves, by, sums).filter(F.col("__n") > 0)
    x = F.col("__at").cast("double")
    bins = spread(cells, low, high).select(
        *by,
        F.col("__at").alias("low"),
        F.col("__at").alias("high"),
        *["__n", "__k_0", "__k_1", "__s_0", "__q_0"],
        (F.col("__a") + F.col("__b") * x).alias("__s_1"),
        (F.col("__aa") + F.lit(2.0) * F.col("__ab") * x + F.col("__bb") * x * x).alias("__q_1"),
    )
    return _curves(bins, by, [y, "fitted"], interval, True)


def subject_slopes(frame: DataFrame, y: str, x: str, by: list[str], subject: str = "sub") -> DataFrame:
    """Least-squares intercept and slope of ``y`` on ``x`` for each subject and cell."""
    return frame.groupBy(subject, *by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"),
    )


def slope_summary(slopes: DataFrame, by: list[str]) -> DataFrame:
    """Mean slope per cell with its by-subject standard error."""
    return slopes.groupBy(*by).agg(
        F.avg("slope").alias("mean_slope"),
        (F.stddev_samp("slope") / F.sqrt(F.count("slope"))).alias("se_slope"),
        F.count("slope").alias("n_subjects"),
    )


def choice_logit(clicks: DataFrame, contrast: dict[str, float] = FLUENCY_CODES, col: str = "fluency") -> DataFrame:
    """Logit of choosing the referent on a two-level contrast, in closed form from the four counts."""
    (low, low_code), (high, high_code) = sorted(contrast.items(), key=lambda kv: kv[1])

    def count(level: str, choice: str):
        return F.count_if((F.col(col) == level) & (F.col("clicked") == choice)).cast("double")

    counts = clicks.agg(
        count(low, "ref").alias("a"),
        count(low, "dis").alias("b"),
        count(high, "ref").alias("c"),
        count(high, "dis").alias("d"),
    )
    low_odds, high_odds = F.log(F.col("a") / F.col("b")), F.log(F.col("c") / F.col("d"))
    slope = (high_odds - low_odds) / F.lit(high_code - low_code)
    ones = [F.lit(1.0) / F.col(k) for k in "abcd"]
    se = F.sqrt(ones[0] + ones[1] + ones[2] + ones[3]) / F.lit(high_code - low_code)
    return counts.select(
        (low_odds - slope * F.lit(low_code)).alias("intercept"),
        slope.alias("slope"),
        se.alias("se_slope"),
        (slope / se).alias("z"),
    )


def choice_regression(clicks: DataFrame, predictors: list[str], steps: int = 8) -> DataFrame:
    """Logit of choosing the referent on several numeric predictors: ``term, estimate, se, z``.

    Trials are counted per combination of predictor values once; every Newton step adds up gradient and information
    over these counts in one row, of which the driver solves a system as small as the number of predictors.  Rows
    with an unknown choice or predictor are left out.  If choices are separated by the predictors, or the predictors
    by each other, estimates and errors are null.
    """
    known = F.col("clicked").isNotNull()
    for p in predictors:
        known &= F.col(p).isNotNull()
    values = [F.col(p).cast("double").alias(f"__x_{i}") for i, p in enumerate(predictors, 1)]
    counts = clicks.filter(known).groupBy(*values).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.count_if(F.col("clicked") == "ref").cast("double").alias("__k")
    )
    counts = checkpointed(counts)
    size = len(predictors) + 1
    x = [F.lit(1.0), *[F.col(f"__x_{i}") for i in range(1, size)]]

    def sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(at, x)])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        weight = F.col("__n") * p * (F.lit(1.0) - p)
        slopes = [F.sum((F.col("__k") - F.col("__n") * p) * c) for c in x]
        curves = [F.sum(weight * x[i] * x[j]) for i in range(size) for j in range(size)]
        row = [0.0 if v is None else v for v in counts.agg(*slopes, *curves).first()]
        return np.array(row[:size]), np.array(row[size:]).reshape(size, size)

    at, error = np.zeros(size), np.full(size, np.nan)
    try:
        for _ in range(steps):
            slope, information = sums(at)
            at = at + np.linalg.solve(information, slope)
        slope, information = sums(at)
        error = np.sqrt(np.diag(np.linalg.inv(information)))
    except np.linalg.LinAlgError:
        at = np.full(size, np.nan)
    found = np.isfinite(at).all() and np.isfinite(error).all() and error.max() < 1e3
    terms = ["intercept", *predictors]
    rows = [(t, *([float(b), float(e), float(b / e)] if found else [None] * 3)) for t, b, e in zip(terms, at, error)]
    return clicks.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double")


def choice_glm(clicks: DataFrame, predictors: list[str]):
    """Binomial regression of a referent choice on several numeric predictors (fitted by Spark ML)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    labelled = clicks.withColumn("__y", (F.col("clicked") == "ref").cast("double"))
    ready = VectorAssembler(inputCols=predictors, outputCol="__x").transform(labelled)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="__y", featuresCol="__x")
    return glm.fit(ready)


def fitted_timecourse(
    frame: DataFrame,
    slopes: DataFrame,
    by: list[str],
    y: str = "elog_bias",
    x: str = "time_z",
    subject: str = "sub",
    bin: str = "bin",
    interval: float = 20,
) -> DataFrame:
    """Observed and fitted time courses side by side.

    The fit is linear, so a subject's mean fitted value in a bin is the fit at the mean of ``x``: the
    coefficients are joined to the aggregated subject curves, not to every row.
    """
    curves = frame.groupBy(subject, *by, bin).agg(
        _mean(y, "propagate").alias("observed"), _mean(x, "propagate").alias("__x")
    )
    joined = curves.join(slopes.select(subject, *by, "slope", "intercept"), [subject, *by], "left")
    both = joined.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("__x"))
    out = []
    for i, m in enumerate(["observed", "fitted"]):
        complete = F.count(m) == F.count(F.lit(1))
        out += [
            _mean(m, "propagate").alias(f"__mean_{i}"),
            F.when(complete, F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"__se_{i}"),
        ]
    wide = both.groupBy(*by, bin).agg(*out)
    return _with_interval(_stack(wide, [*by, bin], [y, "fitted"]), bin, interval)

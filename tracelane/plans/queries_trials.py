"""Queries for the trial operators: clock, choice, resampling, movement, quality, cohorts, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.functions import code_values, first_where, recode
from tracelane.operators import aggregate as agg
from tracelane.operators import cohort as co
from tracelane.operators import model as mo
from tracelane.operators import quality as qu
from tracelane.operators import resample as rs
from tracelane.operators import trials as tr
from tracelane.operators.intervals import spread
from tracelane.operators.joins import natural_join
from tracelane.operators.skew import hot_keys
from tracelane.plans.catalogue import query
from tracelane.plans.driver_tables import (
    BIN_MS,
    EARLY_CODES,
    LANGUAGE_GROUPS,
    THRESHOLDS,
    model_durations,
    model_events,
    model_participants,
    model_questionnaire,
    model_roster,
    model_runs,
    model_spans,
    model_trajectories,
    model_trials,
    with_attention_trials,
    with_client_columns,
)
from tracelane.plans.oracle_views import r6, statement

TRIAL = ["participant", "trial"]


@query(
    "d1_attention_score",
    statement(f"SELECT participant, att_checkn, {r6('att_check')} AS att_check FROM att", "att"),
)
def d1(spark, sf):
    return tr.attention_score(with_attention_trials(model_events(spark, sf)))


SIDE_BIAS = statement(
    f"SELECT participant, {r6('lside_clicks')} AS lside_clicks, {r6('rside_clicks')} AS rside_clicks FROM sb", "sb"
)


@query("d2_side_bias", SIDE_BIAS)
def d2(spark, sf):
    return tr.side_bias(model_events(spark, sf))


@query(
    "d3_align_trials",
    statement(
        """SELECT participant, trial, seq, condition, refpos, event_type, audio1_start, audio1_duration, audio1_end,
        time FROM al""",
        "al",
    ),
)
def d3(spark, sf):
    aligned = tr.align_trials(model_events(spark, sf), model_durations(spark, sf))
    return aligned.select(
        *TRIAL, "seq", "condition", "refpos", "event_type", "audio1_start", "audio1_duration", "audio1_end", "time"
    )


CHOICE = statement("SELECT participant, trial, fluency, refpos, rt, clicked_lr, clicked FROM oc", "oc")


@query("d4_object_choice", CHOICE)
def d4(spark, sf):
    return tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))


@query("d4_object_choice_aligned", CHOICE)
def d4_aligned(spark, sf):
    return tr.object_choice(tr.align_trials(model_events(spark, sf), model_durations(spark, sf)))


def _grid_sql(view: str) -> str:
    return statement(
        f"""SELECT participant, trial, bin, time, {r6('x')} AS x, {r6('y')} AS y FROM {view}""", view
    )


@query("d5_resample", _grid_sql("binned"))
def d5(spark, sf):
    return rs.resample(tr.align_trials(model_events(spark, sf), model_durations(spark, sf)), BIN_MS)


@query("d5_resample_participant_fill", _grid_sql("binned_p"))
def d5_participant(spark, sf):
    aligned = tr.align_trials(model_events(spark, sf), model_durations(spark, sf))
    return rs.resample(aligned, BIN_MS, "participant")


def _movement_sql(view: str) -> str:
    cols = ", ".join(f"{r6(c)} AS {c}" for c in ["x", "y", *rs.FEATURES])
    return statement(f"SELECT participant, trial, condition, refpos, bin, time, {cols} FROM {view}", view)


@query("d6_trajectories", _movement_sql("mv"))
def d6(spark, sf):
    """Clock, resampling and movement features fused."""
    return model_trajectories(spark, sf)


@query("d6_trajectories_participant_fill", _movement_sql("mv_p"))
def d6_participant(spark, sf):
    return model_trajectories(spark, sf, "participant")


@query("d6_movement_features", _movement_sql("mv"))
def d6_steps(spark, sf):
    """The same, one step at a time."""
    events, durations = model_events(spark, sf), model_durations(spark, sf)
    grid = rs.resample(tr.align_trials(events, durations), BIN_MS)
    constant = tr.trial_onsets(events).select(*TRIAL, "condition", "refpos")
    placed = natural_join(grid, constant, "left", TRIAL, null_safe=False, spread=["bin"], hot=long_grids(spark, sf))
    rows = rs.movement_features(placed)
    return rows.select(*TRIAL, "condition", "refpos", "bin", "time", "x", "y", *rs.FEATURES)


TRIAL_COLUMNS = """participant, trial, trialstart, audio_played, datapoints, clicktime, clicked, trial_condition,
        browser, version, os"""


@query("d7_trial_info", statement(f"SELECT {TRIAL_COLUMNS} FROM ti", "ti"))
def d7(spark, sf):
    return tr.trial_info(with_client_columns(model_events(spark, sf)), model_durations(spark, sf))


PPT_SQL = f"""participant, total_trials, empty_trials, crit_trials, crit_nonempty_trials,
    {r6('att_check')} AS att_check, n_clickprenoun_nonempty, {r6('p_clickprenoun_nonempty')} AS p_clickprenoun_nonempty,
    {r6('avg_clicktime')} AS avg_clicktime, strftime(first_time1, '%Y-%m-%d %H:%M:%S') AS first_time1,
    strftime(last_time, '%Y-%m-%d %H:%M:%S') AS last_time, {r6('time_taken')} AS time_taken, browser, version, os"""
PPT_COLUMNS = [
    "participant",
    "total_trials",
    "empty_trials",
    "crit_trials",
    "crit_nonempty_trials",
    "att_check",
    "n_clickprenoun_nonempty",
    "p_clickprenoun_nonempty",
    "avg_clicktime",
    "first_time1",
    "last_time",
    "time_taken",
    "browser",
    "version",
    "os",
]


def _times_as_text(df):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.withColumns({c: F.date_format(c, fmt) for c in ("first_time1", "last_time")})


@query("d8_participant_info", statement(f"SELECT {PPT_SQL} FROM pi", "pi"))
def d8(spark, sf):
    return _times_as_text(qu.participant_info(model_trials(spark, sf))).select(*PPT_COLUMNS)


@query(
    "d9_attach_questionnaire",
    statement(
        """SELECT pi.participant, pi.total_trials, lang.bilingual, lang.bilingual2 FROM pi
        LEFT JOIN lang ON lang.participant = pi.participant""",
        "pi",
        "lang",
    ),
)
def d9(spark, sf):
    ppt = qu.participant_info(model_trials(spark, sf))
    out = qu.attach_questionnaire(ppt, model_questionnaire(spark, sf), LANGUAGE_GROUPS)
    return out.select("participant", "total_trials", "bilingual", "bilingual2")


@query("d10_participant_inclusion", statement("SELECT participant, include_ppt FROM ppt", "ppt"))
def d10(spark, sf):
    return model_participants(spark, sf).select("participant", "include_ppt")


CRITERIA = """CASE WHEN total_trials >= 5 THEN 1 WHEN total_trials < 5 THEN 0 END AS criterion1_total_trials55,
    CASE WHEN crit_nonempty_trials >= 3 THEN 1 WHEN crit_nonempty_trials < 3 THEN 0 END AS criterion2_crittrials15,
    CASE WHEN att_check >= 0.5 THEN 1 WHEN att_check < 0.5 THEN 0 END AS criterion3_attention_check2,
    CASE WHEN p_clickprenoun_nonempty <= 60 THEN 1 WHEN p_clickprenoun_nonempty > 60 THEN 0 END AS criterion4_pclick10,
    CASE WHEN lside_clicks BETWEEN 0.1 AND 0.9 THEN 1 WHEN lside_clicks NOT BETWEEN 0.1 AND 0.9 THEN 0 END
      AS criterion5_Lsideclicks10,
    CASE WHEN avg_clicktime >= 200 THEN 1 WHEN avg_clicktime < 200 THEN 0 END AS criterion6_avgclicktime200"""


@query("d11_inclusion_criteria_flags", statement(f"SELECT participant, {CRITERIA} FROM ppt", "ppt"))
def d11(spark, sf):
    flags = qu.inclusion_criteria_flags(model_participants(spark, sf), THRESHOLDS)
    return flags.select("participant", *[c for c in flags.columns if "criterion" in c])


@query("d12_trial_inclusion", statement("SELECT participant, trial, include_trial FROM ti2", "ti2"))
def d12(spark, sf):
    return qu.trial_inclusion(model_trials(spark, sf)).select(*TRIAL, "include_trial")


@query(
    "d13_resolve_duplicates",
    statement(
        """SELECT participant, mturk_id, duplicate, duplicate2, coalesce(include_ppt, 'NA') || ' : ' || duplicate2
        AS dup_incl, submitted FROM dups""",
        "dups",
    ),
)
def d13(spark, sf):
    out = qu.resolve_duplicates(model_participants(spark, sf), model_roster(spark, sf), EARLY_CODES)
    return out.select("participant", "mturk_id", "duplicate", "duplicate2", "dup_incl", "submitted")


def two_cohorts(df):
    """Split by participant parity into an online and a lab cohort."""
    even = F.col("participant") % 2 == 0
    return {"Mturk": df.filter(even), "LAB": df.filter(~even)}


@query(
    "d14_merge_cohorts",
    statement(
        """SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort, participant, total_trials
        FROM pi WHERE NOT (participant % 2 = 1 AND total_trials <= 4) AND NOT (participant % 2 = 0 AND participant <= 20)""",
        "pi",
    ),
)
def d14(spark, sf):
    ppt = qu.participant_info(model_trials(spark, sf)).select("participant", "total_trials")
    return co.merge_cohorts(co.cohort_exclusion(4, 20), **two_cohorts(ppt))


def _course_sql(view: str, measures: list[str], subject: str, by: list[str], strict: bool, where: str = "true") -> str:
    """Both levels of a time course, one measure after the other."""
    cell = ", ".join([*by, "bin"])
    parts = []
    for m in measures:
        inner = f"CASE WHEN count({m}) = count(*) THEN avg({m}) END" if strict else f"avg({m})"
        if strict:
            mean = "CASE WHEN count(v) = count(*) THEN avg(v) END"
            se = "CASE WHEN count(v) = count(*) THEN stddev_samp(v) / sqrt(count(*)) END"
        else:
            mean, se = "avg(v)", "stddev_samp(v) / sqrt(count(v))"
        parts.append(
            f"""SELECT {cell}, '{m}' AS "AOI", {r6('m')} AS mean_prop, {r6('se')} AS se, {r6('m - se')} AS low,
            {r6('m + se')} AS up, bin * 3600000 AS time FROM (SELECT {cell}, {mean} AS m, {se} AS se FROM (
            SELECT {subject}, {cell}, {inner} AS v FROM {view} WHERE {where} GROUP BY {subject}, {cell})
            GROUP BY {cell})"""
        )
    return " UNION ALL ".join(parts)


@query(
    "d15_timecourse",
    statement(_course_sql("mv", ["refprop", "disprop"], "participant", ["condition"], True), "mv"),
)
def d15(spark, sf):
    return agg.timecourse_of_runs(
        model_runs(spark, sf), ["refprop", "disprop"], "participant", ["condition"], interval=BIN_MS
    )


@query(
    "d15_timecourse_skip_missing",
    statement(_course_sql("mv", ["refprop", "disprop"], "participant", ["condition"], False), "mv"),
)
def d15_skip(spark, sf):
    return agg.timecourse_of_runs(
        model_runs(spark, sf),
        ["refprop", "disprop"],
        "participant",
        ["condition"],
        interval=BIN_MS,
        na="skip",
    )


@query(
    "a11_two_level_timecourse",
    statement(
        _course_sql("merged", ["refprop", "disprop"], "participant", ["condition", "cohort"], False), "merged"
    ),
)
def a11(spark, sf):
    cohort = F.when(F.col("participant") % 2 == 0, "Mturk").otherwise("LAB")
    runs = model_runs(spark, sf).withColumn("cohort", cohort)
    return agg.timecourse_of_runs(
        runs, ["refprop", "disprop"], "participant", ["condition", "cohort"], interval=BIN_MS, na="skip"
    )


def _rows_course_sql(measures: list[str]) -> str:
    parts = [
        f"""SELECT bin, condition, '{m}' AS "AOI", {r6('m')} AS mean_prop, {r6('se')} AS se, {r6('m - se')} AS low,
        {r6('m + se')} AS up, bin * 3600000 AS time FROM (SELECT bin, condition,
        CASE WHEN count({m}) = count(*) THEN avg({m}) END AS m, stddev_samp({m}) / sqrt(count({m})) AS se
        FROM mv GROUP BY bin, condition)"""
        for m in measures
    ]
    return statement(" UNION ALL ".join(parts), "mv")


@query("a12_one_level_timecourse", _rows_course_sql(["refprop", "disprop"]))
def a12(spark, sf):
    return agg.timecourse_rows(
        model_trajectories(spark, sf), ["refprop", "disprop"], ["condition"], interval=BIN_MS
    )


ELOG = {
    "as_written": "(ln(refprop + .5 / (1 - refprop + .5)) - ln(disprop + .5 / (1 - disprop + .5)))",
    "standard": "(ln((refprop + .5) / (1 - refprop + .5)) - ln((disprop + .5) / (1 - disprop + .5)))",
}
MOVE = "CASE WHEN refprop > disprop THEN 'ref' WHEN disprop > refprop THEN 'dist' WHEN refprop = disprop THEN 'neither' END"
MOVEO = "CASE WHEN refprop > disprop THEN 3 WHEN disprop > refprop THEN 1 WHEN refprop = disprop THEN 2 END"


def long_grids(spark, sf):
    return rs.heavy_grids(model_events(spark, sf), model_durations(spark, sf), BIN_MS)


MAX_SECONDS = 72_000.0


def model_parts(spark, sf):
    """Stretches of the model's rows, and the moments of all chosen bins; neither spreads the grid."""
    events = model_events(spark, sf)
    spans = model_spans(spark, sf).filter(F.col("condition") != "Filler")
    trials = qu.trial_inclusion(model_trials(spark, sf)).select(*TRIAL, "include_trial")
    ppt = model_participants(spark, sf).select("participant", "include_ppt", "bilingual")
    spans = qu.enrich(spans, ppt, trials, spread=["trial"]).withColumns(
        {
            "duplicate2": F.lit("n-dup"),
            "cohort": F.when(F.col("participant") % 2 == 0, "Mturk").otherwise("LAB"),
            "bilingual": F.when(F.col("bilingual").isin("BUILDING", "FURNITURE"), "No").otherwise("Yes"),
        }
    )
    chosen = spans.filter(mo.chosen_rows())
    runs = mo.model_runs(
        model_runs(spark, sf), chosen, BIN_MS, MAX_SECONDS, hot=hot_keys(events, TRIAL)
    )
    return runs, mo.bin_moments(chosen)


FRAME = f"""chosen AS (SELECT mv.*, mv.time / 1000.0 AS time_s, CASE WHEN mv.participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END
    AS cohort FROM mv JOIN ti2 ON ti2.participant = mv.participant AND ti2.trial = mv.trial
    JOIN ppt ON ppt.participant = mv.participant
    WHERE condition <> 'Filler' AND include_ppt = 'valid' AND include_trial = 'valid'
    AND ppt.bilingual IN ('BUILDING', 'FURNITURE')),
frame AS (SELECT participant AS sub, trial AS ref, condition AS fluency, cohort, bin, time_s,
    (time_s - (SELECT avg(time_s) FROM chosen)) / (SELECT stddev_samp(time_s) FROM chosen) AS time_z,
    {ELOG['as_written']} AS elog_bias, {MOVE} AS move, {MOVEO} AS moveo,
    CASE condition WHEN 'Fluent' THEN -0.5::DOUBLE WHEN 'Disfluent' THEN 0.5::DOUBLE END AS fluency_c FROM chosen WHERE time_s <= 72000)"""


def _frame_sql(body: str) -> str:
    head = statement("", "mv", "ti2", "ppt").rstrip()
    return f"{head},\n{FRAME}\n{body}"


@query(
    "d16_model_frame",
    _frame_sql(
        f"""SELECT sub, ref, fluency, cohort, bin, {r6('time_s')} AS time_s, {r6('time_z')} AS time_z,
        {r6('elog_bias')} AS elog_bias, move, moveo, {r6('fluency_c')} AS fluency_c FROM frame"""
    ),
)
def d16(spark, sf):
    runs, moments = model_parts(spark, sf)
    return mo.frame_of_runs(runs, moments, BIN_MS).select(
        "sub", "ref", "fluency", "cohort", "bin", "time_s", "time_z", "elog_bias", "move", "moveo", "fluency_c"
    )


# a single point has no slope: null here, NaN in the oracle engine
SLOPES = """slopes AS (SELECT sub, fluency, cohort, CASE WHEN isfinite(s) THEN s END AS slope,
    CASE WHEN isfinite(i) THEN i END AS intercept, n FROM (SELECT sub, fluency, cohort,
    regr_slope(elog_bias, time_z) AS s, regr_intercept(elog_bias, time_z) AS i, regr_count(elog_bias, time_z) AS n
    FROM frame GROUP BY sub, fluency, cohort))"""


def _slopes_sql(body: str) -> str:
    head = statement("", "mv", "ti2", "ppt").rstrip()
    return f"{head},\n{FRAME},\n{SLOPES}\n{body}"


@query(
    "m1_subject_slopes",
    _slopes_sql(
        f"""SELECT sub, fluency, cohort, {r6('slope')} AS slope, {r6('intercept')} AS intercept,
        CAST(n AS BIGINT) AS n FROM slopes"""
    ),
)
def m1(spark, sf):
    runs, moments = model_parts(spark, sf)
    return mo.slopes_of_runs(runs, "elog_bias", ["fluency", "cohort"], moments)


@query(
    "m1_slope_summary",
    _slopes_sql(
        f"""SELECT fluency, cohort, {r6('avg(slope)')} AS mean_slope,
        {r6('stddev_samp(slope) / sqrt(count(slope))')} AS se_slope, count(slope) AS n_subjects
        FROM slopes GROUP BY fluency, cohort"""
    ),
)
def m1_summary(spark, sf):
    cell = ["fluency", "cohort"]
    runs, moments = model_parts(spark, sf)
    return mo.slope_summary(mo.slopes_of_runs(runs, "elog_bias", cell, moments), cell)


@query(
    "m2_choice_logit",
    statement(
        f"""SELECT {r6('(lo + hi) / 2')} AS intercept, {r6('hi - lo')} AS slope, {r6('se')} AS se_slope,
        {r6('(hi - lo) / se')} AS z FROM (SELECT ln(a / b) AS lo, ln(c / d) AS hi,
        sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM (SELECT
        CAST(count(*) FILTER (WHERE fluency = 'Fluent' AND clicked = 'ref') AS DOUBLE) AS a,
        CAST(count(*) FILTER (WHERE fluency = 'Fluent' AND clicked = 'dis') AS DOUBLE) AS b,
        CAST(count(*) FILTER (WHERE fluency = 'Disfluent' AND clicked = 'ref') AS DOUBLE) AS c,
        CAST(count(*) FILTER (WHERE fluency = 'Disfluent' AND clicked = 'dis') AS DOUBLE) AS d
        FROM oc WHERE clicked <> 'none' AND rt >= 200))""",
        "oc",
    ),
)
def m2(spark, sf):
    choices = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    return mo.choice_logit(choices.filter((F.col("clicked") != "none") & (F.col("rt") >= 200)))


def _newton_sql(steps: int) -> str:
    """Newton steps on counts per pattern, the three equations solved by determinants."""
    g = ["k - n * p", "(k - n * p) * x1", "(k - n * p) * x2"]
    h = {"h00": "w", "h01": "w * x1", "h02": "w * x2", "h11": "w * x1 * x1", "h12": "w * x1 * x2", "h22": "w * x2 * x2"}
    sums = ", ".join([f"sum({e}) AS g{i}" for i, e in enumerate(g)] + [f"sum({e}) AS {n}" for n, e in h.items()])
    inner = f"""SELECT step, b0, b1, b2, {sums} FROM (SELECT *, n * p * (1 - p) AS w FROM (SELECT it.*, pat.*,
        1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, pat)) GROUP BY step, b0, b1, b2"""
    inverse = """(h11 * h22 - h12 * h12) / det AS i00, (h02 * h12 - h01 * h22) / det AS i01,
        (h01 * h12 - h02 * h11) / det AS i02, (h00 * h22 - h02 * h02) / det AS i11, (h01 * h02 - h00 * h12) / det AS i12,
        (h00 * h11 - h01 * h01) / det AS i22"""
    det = """h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det"""
    solved = f"SELECT *, {inverse} FROM (SELECT *, {det} FROM ({inner}))"
    views = statement("", "oc").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{views}, pat AS (SELECT CASE fluency WHEN 'Fluent' THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS x1,
        CASE WHEN participant % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS x2, CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE clicked = 'ref') AS DOUBLE) AS k FROM oc
        WHERE clicked <> 'none' AND rt >= 200 AND fluency <> 'Filler' GROUP BY 1, 2),
    it AS (SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
        SELECT step + 1, b0 + i00 * g0 + i01 * g1 + i02 * g2, b1 + i01 * g0 + i11 * g1 + i12 * g2,
        b2 + i02 * g0 + i12 * g1 + i22 * g2 FROM ({solved}) WHERE step < {steps}),
    last AS (SELECT * FROM ({solved}) WHERE step = {steps})
    SELECT term, {r6('estimate')} AS estimate, {r6('se')} AS se, {r6('estimate / se')} AS z FROM (
        SELECT 'intercept' AS term, b0 AS estimate, sqrt(i00) AS se FROM last UNION ALL
        SELECT 'fluency_c', b1, sqrt(i11) FROM last UNION ALL SELECT 'cohort_c', b2, sqrt(i22) FROM last)"""


@query("m2_choice_regression", _newton_sql(8))
def m2_regression(spark, sf):
    """Choice on condition and cohort."""
    choices = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    answered = choices.filter((F.col("clicked") != "none") & (F.col("rt") >= 200) & (F.col("fluency") != "Filler"))
    cohort = F.when(F.col("participant") % 2 == 0, 0.5).otherwise(-0.5)
    coded = answered.withColumns({"fluency_c": code_values("fluency", mo.FLUENCY_CODES), "cohort_c": cohort})
    return mo.choice_regression(coded, ["fluency_c", "cohort_c"])


def _fitted_sql() -> str:
    parts = [
        f"""SELECT fluency, cohort, bin, '{m}' AS "AOI", {r6('m')} AS mean_prop, {r6('se')} AS se,
        {r6('m - se')} AS low, {r6('m + se')} AS up, bin * 3600000 AS time FROM (
        SELECT fluency, cohort, bin, CASE WHEN count(v) = count(*) THEN avg(v) END AS m,
        CASE WHEN count(v) = count(*) THEN stddev_samp(v) / sqrt(count(*)) END AS se FROM (
          SELECT f.sub, f.fluency, f.cohort, f.bin, CASE WHEN count({e}) = count(*) THEN avg({e}) END AS v
          FROM frame f LEFT JOIN slopes s ON s.sub = f.sub AND s.fluency = f.fluency AND s.cohort = f.cohort
          GROUP BY f.sub, f.fluency, f.cohort, f.bin) GROUP BY fluency, cohort, bin)"""
        for m, e in {"elog_bias": "elog_bias", "fitted": "s.intercept + s.slope * f.time_z"}.items()
    ]
    return _slopes_sql(" UNION ALL ".join(parts))


@query("m3_fitted_timecourse", _fitted_sql())
def m3(spark, sf):
    cell = ["fluency", "cohort"]
    runs, _ = model_parts(spark, sf)
    return mo.fitted_of_runs(runs, cell, interval=BIN_MS)


@query(
    "p13_elog_as_written",
    statement(f"SELECT participant, trial, bin, {r6(ELOG['as_written'])} AS elog_bias FROM mv", "mv"),
)
def p13(spark, sf):
    return mo.bias_columns(model_trajectories(spark, sf)).select(*TRIAL, "bin", "elog_bias")


@query(
    "p13_elog_standard",
    statement(f"SELECT participant, trial, bin, {r6(ELOG['standard'])} AS elog_bias FROM mv", "mv"),
)
def p13_standard(spark, sf):
    return mo.bias_columns(model_trajectories(spark, sf), "standard").select(*TRIAL, "bin", "elog_bias")


@query("p14_move_category", statement(f"SELECT participant, trial, bin, {MOVE} AS move FROM mv", "mv"))
def p14(spark, sf):
    return mo.bias_columns(model_trajectories(spark, sf)).select(*TRIAL, "bin", "move")


@query("p12_level_code", statement(f"SELECT participant, trial, bin, {MOVEO} AS moveo FROM mv", "mv"))
def p12(spark, sf):
    return mo.bias_columns(model_trajectories(spark, sf)).select(*TRIAL, "bin", "moveo")


@query(
    "w6_zscore",
    statement(
        f"""SELECT participant, trial, bin, {r6('time_z')} AS time_z FROM (SELECT *,
        (time / 1000.0 - (SELECT avg(time / 1000.0) FROM mv)) / (SELECT stddev_samp(time / 1000.0) FROM mv) AS time_z
        FROM mv) WHERE time / 1000.0 <= 72000""",
        "mv",
    ),
)
def w6(spark, sf):
    """Moments of all bins in closed form from the grids' ends; late bins are cut before the grids are spread."""
    spans = model_spans(spark, sf)
    moments = mo.bin_moments(spans)
    last = F.lit(int(MAX_SECONDS * 1000 // BIN_MS)).cast("long")
    early = spans.filter(F.col("low") <= last)
    rows = spread(early, F.col("low"), F.least("high", last)).withColumnRenamed("__at", "bin")
    return rows.select(*TRIAL, "bin", mo.standardised("bin", moments).alias("time_z"))


@query(
    "w2_lag_difference",
    statement(
        f"""SELECT participant, trial, bin, {r6('x - lag(x) OVER (PARTITION BY participant, trial ORDER BY bin)')}
        AS step FROM binned""",
        "binned",
    ),
)
def w2(spark, sf):
    grid = model_trajectories(spark, sf).select(*TRIAL, "bin", "x")
    return agg.step_features(grid, TRIAL, "bin", "x").select(*TRIAL, "bin", "step")


@query(
    "w3_running_absolute_sum",
    statement(
        f"""SELECT participant, trial, bin, CASE WHEN nth > 1 AND count(*) FILTER (WHERE nth > 1 AND step IS NULL) OVER w
        = 0 THEN {r6('sum(abs(step)) OVER w')} END AS cumulative FROM (SELECT *, x - lag(x) OVER v AS step,
        row_number() OVER v AS nth FROM binned WINDOW v AS (PARTITION BY participant, trial ORDER BY bin))
        WINDOW w AS (PARTITION BY participant, trial ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "binned",
    ),
)
def w3(spark, sf):
    grid = model_trajectories(spark, sf).select(*TRIAL, "bin", "x")
    return agg.step_features(grid, TRIAL, "bin", "x").select(*TRIAL, "bin", "cumulative")


@query(
    "w4_directional_sums",
    statement(
        f"SELECT participant, trial, bin, {r6('ref_cdist')} AS ref_cdist, {r6('dis_cdist')} AS dis_cdist FROM mv",
        "mv",
    ),
)
def w4(spark, sf):
    return model_trajectories(spark, sf).select(*TRIAL, "bin", "ref_cdist", "dis_cdist")


@query(
    "w8_lag1_autocorrelation",
    statement(
        f"""SELECT participant, trial, {r6('CASE WHEN isfinite(c) THEN c END')} AS autocorr FROM (
        SELECT participant, trial, CASE WHEN count(p) > 1 AND stddev_pop(a) > 1e-9 AND stddev_pop(p) > 1e-9
        THEN corr(a, p) END AS c FROM (SELECT participant, trial,
        CASE WHEN lag(y) OVER v IS NOT NULL THEN y END AS a, CASE WHEN y IS NOT NULL THEN lag(y) OVER v END AS p
        FROM binned WINDOW v AS (PARTITION BY participant, trial ORDER BY bin)) GROUP BY participant, trial)""",
        "binned",
    ),
)
def w8(spark, sf):
    grid = model_trajectories(spark, sf).select(*TRIAL, "bin", "y")
    return agg.lag1_autocorr(grid, TRIAL, "bin", "y")


@query(
    "f7_axis_window",
    statement(
        f"""SELECT * FROM ({_course_sql('mv', ['refprop', 'disprop'], 'participant', ['condition'], False)})
        WHERE time BETWEEN 0 AND 72000000 AND mean_prop BETWEEN 0 AND 1""",
        "mv",
    ),
)
def f7(spark, sf):
    from tracelane.operators.clean import clip_axes

    course = agg.timecourse(
        model_trajectories(spark, sf),
        ["refprop", "disprop"],
        "participant",
        ["condition"],
        interval=BIN_MS,
        na="skip",
    )
    return clip_axes(course, "time", "mean_prop", (0, 72_000_000))


@query(
    "f5_cohort_exclusion",
    statement(
        """SELECT cohort, participant, trial, bin FROM merged
        WHERE NOT (cohort = 'LAB' AND total_trials <= 4) AND NOT (cohort = 'Mturk' AND participant <= 20)""",
        "merged",
    ),
)
def f5(spark, sf):
    rows = co.union_cohorts(**two_cohorts(model_trajectories(spark, sf).select(*TRIAL, "bin")))
    ppt = qu.participant_info(model_trials(spark, sf)).select("participant", "total_trials")
    known = natural_join(rows, ppt, "left", ["participant"], null_safe=False, spread=["trial", "bin"])
    return known.filter(co.cohort_exclusion(4, 20)).select("cohort", *TRIAL, "bin")


@query(
    "f6_analysis_population",
    statement(
        """SELECT participant, duplicate2 FROM dups WHERE bilingual2 = 'Monolingual' AND duplicate2 = 'n-dup'
        AND include_ppt = 'valid'""",
        "dups",
    ),
)
def f6(spark, sf):
    out = qu.resolve_duplicates(model_participants(spark, sf), model_roster(spark, sf), EARLY_CODES)
    return out.filter(co.analysis_population()).select("participant", "duplicate2")


@query(
    "j9_enrich_bins",
    statement(
        f"""SELECT mv.participant, mv.trial, mv.bin, {r6('mv.refprop')} AS refprop, ppt.include_ppt, ppt.bilingual2,
        ppt.total_trials, ti2.clicked, ti2.clicktime, ti2.include_trial FROM mv
        LEFT JOIN ppt ON ppt.participant = mv.participant
        LEFT JOIN ti2 ON ti2.participant = mv.participant AND ti2.trial = mv.trial WHERE mv.condition <> 'Filler'""",
        "mv",
        "ppt",
        "ti2",
    ),
)
def j9(spark, sf):
    binned = model_trajectories(spark, sf).filter(F.col("condition") != "Filler")
    trials = qu.trial_inclusion(model_trials(spark, sf))
    rows = qu.enrich(binned, model_participants(spark, sf), trials, spread=["bin"], hot=long_grids(spark, sf))
    return rows.select(
        *TRIAL, "bin", "refprop", "include_ppt", "bilingual2", "total_trials", "clicked", "clicktime", "include_trial"
    )


@query(
    "j9_enrich_bins_natural_keys",
    statement(
        """SELECT mv.participant, mv.trial, mv.bin, ppt.total_trials, ti2.clicked, ti2.clicktime FROM mv
        LEFT JOIN ppt ON ppt.participant = mv.participant
        LEFT JOIN ti2 ON ti2.participant = mv.participant AND ti2.trial = mv.trial
        AND ti2.att_check IS NOT DISTINCT FROM ppt.att_check AND ti2.browser IS NOT DISTINCT FROM ppt.browser
        AND ti2.version IS NOT DISTINCT FROM ppt.version AND ti2.os IS NOT DISTINCT FROM ppt.os""",
        "mv",
        "ppt",
        "ti2",
    ),
)
def j9_natural(spark, sf):
    binned = model_trajectories(spark, sf)
    rows = qu.enrich(binned, model_participants(spark, sf), model_trials(spark, sf), "natural", ["bin"])
    return rows.select(*TRIAL, "bin", "total_trials", "clicked", "clicktime")


@query(
    "j10_enrich_events",
    statement(
        """SELECT ev.participant, ev.trial, ev.seq, ppt.include_ppt, ti2.clicked, ti2.include_trial FROM ev
        LEFT JOIN ppt ON ppt.participant = ev.participant
        LEFT JOIN ti2 ON ti2.participant = ev.participant AND ti2.trial = ev.trial WHERE ev.condition <> 'Filler'""",
        "ev",
        "ppt",
        "ti2",
    ),
)
def j10(spark, sf):
    events = model_events(spark, sf).filter(F.col("condition") != "Filler").select(*TRIAL, "seq")
    trials = qu.trial_inclusion(model_trials(spark, sf))
    rows = qu.enrich(events, model_participants(spark, sf), trials, spread=["seq"])
    return rows.select(*TRIAL, "seq", "include_ppt", "clicked", "include_trial")


@query(
    "j11_enrich_clicks",
    statement(
        """SELECT oc.participant, oc.trial, oc.fluency, oc.rt, oc.clicked, ppt.include_ppt, ti2.clicktime,
        ti2.include_trial FROM oc LEFT JOIN ppt ON ppt.participant = oc.participant
        LEFT JOIN ti2 ON ti2.participant = oc.participant AND ti2.trial = oc.trial WHERE oc.fluency <> 'Filler'""",
        "oc",
        "ppt",
        "ti2",
    ),
)
def j11(spark, sf):
    clicks = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    clicks = clicks.filter(F.col("fluency") != "Filler")
    trials = qu.trial_inclusion(model_trials(spark, sf))
    rows = qu.enrich(clicks, model_participants(spark, sf), trials, spread=["participant"])
    return rows.select(*TRIAL, "fluency", "rt", "clicked", "include_ppt", "clicktime", "include_trial")


_NATURAL = """LEFT JOIN ti2 ON ti2.participant = {0}.participant AND ti2.trial = {0}.trial
        AND ti2.att_check IS NOT DISTINCT FROM ppt.att_check AND ti2.browser IS NOT DISTINCT FROM ppt.browser
        AND ti2.version IS NOT DISTINCT FROM ppt.version AND ti2.os IS NOT DISTINCT FROM ppt.os"""


@query(
    "j10_enrich_events_natural_keys",
    statement(
        f"""SELECT ev.participant, ev.trial, ev.seq, ppt.total_trials, ti2.clicked, ti2.clicktime FROM ev
        LEFT JOIN ppt ON ppt.participant = ev.participant {_NATURAL.format("ev")}""",
        "ev",
        "ppt",
        "ti2",
    ),
)
def j10_natural(spark, sf):
    events = model_events(spark, sf).select(*TRIAL, "seq")
    rows = qu.enrich(events, model_participants(spark, sf), model_trials(spark, sf), "natural", ["seq"])
    return rows.select(*TRIAL, "seq", "total_trials", "clicked", "clicktime")


@query(
    "j11_enrich_clicks_natural_keys",
    statement(
        f"""SELECT oc.participant, oc.trial, oc.fluency, oc.rt, oc.clicked, ppt.total_trials, ti2.datapoints FROM oc
        LEFT JOIN ppt ON ppt.participant = oc.participant {_NATURAL.format("oc")}
        AND ti2.clicked IS NOT DISTINCT FROM oc.clicked""",
        "oc",
        "ppt",
        "ti2",
    ),
)
def j11_natural(spark, sf):
    """The choice is a shared column too."""
    clicks = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    clicks = clicks.select(*TRIAL, "fluency", "rt", "clicked")
    rows = qu.enrich(clicks, model_participants(spark, sf), model_trials(spark, sf), "natural", ["trial"])
    return rows.select(*TRIAL, "fluency", "rt", "clicked", "total_trials", "datapoints")


@query(
    "p10_recode",
    """SELECT c_custkey AS participant, CASE c_mktsegment WHEN 'BUILDING' THEN 'Monolingual' WHEN 'FURNITURE' THEN
    'Monolingual' WHEN 'MACHINERY' THEN 'Bilingual' ELSE c_mktsegment END AS bilingual2 FROM customer""",
)
def p10(spark, sf):
    answers = qu.questionnaire_answer(model_questionnaire(spark, sf), "language", "bilingual")
    return answers.select("participant", recode("bilingual", LANGUAGE_GROUPS).alias("bilingual2"))


@query(
    "a9_first_index",
    statement(
        """SELECT mturk_id, first_index, first_value FROM (SELECT mturk_id, min(nth) FILTER (WHERE ok) AS first_index,
        arg_min(participant, participant) FILTER (WHERE ok) AS first_value FROM (SELECT mturk_id, participant,
        crit_nonempty_trials >= 4 AS ok, row_number() OVER (PARTITION BY mturk_id ORDER BY participant) AS nth FROM ppt)
        GROUP BY mturk_id)""",
        "ppt",
    ),
)
def a9(spark, sf):
    ppt = model_participants(spark, sf).select("mturk_id", "participant", "crit_nonempty_trials")
    return agg.first_index(ppt, ["mturk_id"], F.col("crit_nonempty_trials") >= 4, "participant", "participant")


@query(
    "a1_ordered_first_last",
    statement(
        """SELECT participant, trial, arg_min_null(layer, seq) AS first_layer,
        arg_max_null(x, seq) FILTER (WHERE event_type = 'click') AS last_click_x,
        arg_max_null(x, seq) AS last_x, arg_min_null(elapsed, seq) FILTER (WHERE event_type = 'playbackstart') AS onset
        FROM ev GROUP BY participant, trial""",
        "ev",
    ),
)
def a1(spark, sf):
    from tracelane.functions import last_where

    return (
        model_events(spark, sf)
        .groupBy(*TRIAL)
        .agg(
            first_where("layer", None, "seq").alias("first_layer"),
            last_where("x", F.col("event_type") == "click", "seq").alias("last_click_x"),
            last_where("x", None, "seq").alias("last_x"),
            first_where("elapsed", F.col("event_type") == "playbackstart", "seq").alias("onset"),
        )
    )


DISTANCES = ["x_step_end", "distance_travelled", "cumulative_distance", "ref_cdist", "dis_cdist"]


@query(
    "j6_derived_distances",
    statement(
        f"SELECT participant, trial, bin, {', '.join(f'{r6(c)} AS {c}' for c in DISTANCES)} FROM mv", "mv"
    ),
)
def j6(spark, sf):
    """What the three self-joins attach to the grid, from windows instead."""
    return model_trajectories(spark, sf).select(*TRIAL, "bin", *DISTANCES)


@query(
    "x10_differences_and_running_sums",
    statement(
        f"""SELECT participant, seq, k - lag(k) OVER v AS step, CASE WHEN lag(k) OVER v IS NOT NULL THEN
        {r6('sum(abs(d)) OVER w')} END AS cumulative FROM (SELECT participant, seq, k,
        CAST(k - lag(k) OVER (PARTITION BY participant ORDER BY seq) AS DOUBLE) AS d FROM ev)
        WINDOW v AS (PARTITION BY participant ORDER BY seq),
        w AS (PARTITION BY participant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "ev",
    ),
)
def x10(spark, sf):
    rows = model_events(spark, sf).select("participant", "seq", "k")
    return agg.step_features(rows, ["participant"], "seq", "k", sparse=True).drop("k")

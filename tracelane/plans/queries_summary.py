"""Queries for aggregates, report tables, duplicates and simple joins of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.functions import any_equal, distinct_where, share_where, strict_avg, strict_sum
from tracelane.operators import aggregate as agg
from tracelane.operators import cohort as co
from tracelane.operators import quality as qu
from tracelane.operators import trials as tr
from tracelane.operators.clean import coalesce_shifted
from tracelane.operators.joins import attach_durations, membership_flag, natural_join
from tracelane.operators.resample import bin_mean
from tracelane.functions import to_bin
from tracelane.plans.catalogue import query
from tracelane.plans.driver_tables import (
    BIN_MS,
    THRESHOLDS,
    model_attention,
    model_durations,
    model_events,
    model_participants,
    model_questionnaire,
    model_roster,
    model_trials,
    with_attention_trials,
    with_client_columns,
)
from tracelane.plans.oracle_views import r6, statement, to_bin as bin_sql
from tracelane.plans.queries_trials import CRITERIA, SIDE_BIAS, two_cohorts

TRIAL = ["participant", "trial"]


@query(
    "a2_conditional_share",
    statement(
        f"""SELECT participant, count(*) FILTER (WHERE layer = 'background') AS n_background,
        {r6("count(*) FILTER (WHERE x > 0) / CAST(count(*) AS DOUBLE)")} AS right_share FROM ev GROUP BY participant""",
        "ev",
    ),
)
def a2(spark, sf):
    return (
        model_events(spark, sf)
        .groupBy("participant")
        .agg(
            F.count_if(F.col("layer") == "background").alias("n_background"),
            share_where(F.col("x") > 0).alias("right_share"),
        )
    )


@query(
    "a3_any_event_flag",
    statement(
        """SELECT participant, trial, CAST(bool_or(event_type = 'playbackstart') AS INTEGER) AS audio_played
        FROM ev GROUP BY participant, trial""",
        "ev",
    ),
)
def a3(spark, sf):
    return (
        model_events(spark, sf)
        .groupBy(*TRIAL)
        .agg(any_equal("event_type", "playbackstart").alias("audio_played"))
    )


@query(
    "a4_distinct_counts",
    statement(
        """SELECT participant, count(DISTINCT trial) AS total_trials,
        count(DISTINCT CASE WHEN condition <> 'Filler' THEN trial END) AS crit_trials FROM ev GROUP BY participant""",
        "ev",
    ),
)
def a4(spark, sf):
    return (
        model_events(spark, sf)
        .groupBy("participant")
        .agg(
            distinct_where("trial").alias("total_trials"),
            distinct_where("trial", F.col("condition") != "Filler").alias("crit_trials"),
        )
    )


@query(
    "a5_means_and_missing",
    statement(
        f"""SELECT participant, trial, {r6('avg(x)')} AS mean_known, {r6('CASE WHEN count(x) = count(*) THEN avg(x) END')}
        AS mean_strict, {r6('CASE WHEN count(y) = count(*) THEN sum(y) END')} AS sum_strict FROM ev GROUP BY participant, trial""",
        "ev",
    ),
)
def a5(spark, sf):
    return (
        model_events(spark, sf)
        .groupBy(*TRIAL)
        .agg(
            F.avg("x").alias("mean_known"),
            strict_avg("x").alias("mean_strict"),
            strict_sum("y").alias("sum_strict"),
        )
    )


@query(
    "a6_guarded_times",
    statement(
        f"""SELECT participant, strftime(first_time1, '%Y-%m-%d %H:%M:%S') AS first_time1,
        strftime(last_time, '%Y-%m-%d %H:%M:%S') AS last_time, {r6('time_taken')} AS time_taken FROM pi""",
        "pi",
    ),
)
def a6(spark, sf):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return qu.participant_info(model_trials(spark, sf)).select(
        "participant",
        F.date_format("first_time1", fmt).alias("first_time1"),
        F.date_format("last_time", fmt).alias("last_time"),
        "time_taken",
    )


@query(
    "a7_attempts_as_text",
    statement(
        """SELECT * FROM (SELECT mturk_id, row_number() OVER (PARTITION BY mturk_id ORDER BY seq) AS position,
        count(*) OVER (PARTITION BY mturk_id) AS nr_attempts, replace(batch, 'batch ', '') AS batch, comments FROM roster)
        WHERE nr_attempts > 1""",
        "roster",
    ),
)
def a7(spark, sf):
    return agg.attempts(model_roster(spark, sf), batch_prefix="batch ")


@query(
    "a8_attempts_as_list",
    statement(
        "SELECT mturk_id, row_number() OVER (PARTITION BY mturk_id ORDER BY seq) AS position, batch FROM roster",
        "roster",
    ),
)
def a8(spark, sf):
    return agg.listed_attempts(model_roster(spark, sf))


@query(
    "a10_bin_mean",
    statement(
        f"SELECT participant, trial, bin, {r6('x')} AS x, {r6('y')} AS y FROM xy",
        "xy",
    ),
)
def a10(spark, sf):
    aligned = tr.align_trials(model_events(spark, sf), model_durations(spark, sf))
    timed = aligned.filter(F.col("time").isNotNull())
    return bin_mean(timed, TRIAL, to_bin("time", BIN_MS), ["x", "y"], F.col("event_category") == "mouse")


@query(
    "a13_frequency_overall",
    statement(
        f"""SELECT clicked, count(*) AS n, {r6("count(*) / CAST((SELECT count(*) FROM oc) AS DOUBLE)")} AS prop
        FROM oc GROUP BY clicked""",
        "oc",
    ),
)
def a13(spark, sf):
    choices = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    return agg.freq_table(choices, ["clicked"])


@query(
    "a13_frequency_by_row",
    statement(
        f"""SELECT fluency, clicked, n, {r6("n / CAST(sum(n) OVER (PARTITION BY fluency) AS DOUBLE)")} AS prop
        FROM (SELECT f.fluency, c.clicked, count(oc.clicked) AS n FROM (SELECT DISTINCT fluency FROM oc) f
        CROSS JOIN (SELECT DISTINCT clicked FROM oc) c LEFT JOIN oc ON oc.fluency = f.fluency AND oc.clicked = c.clicked
        GROUP BY ALL)""",
        "oc",
    ),
)
def a13_rows(spark, sf):
    choices = tr.object_choice_from_events(model_events(spark, sf), model_durations(spark, sf))
    return agg.freq_table(choices, ["fluency", "clicked"], ["fluency"])


@query(
    "a13_outside_share",
    statement(
        f"""SELECT outside, count(*) AS n, {r6("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)")} AS prop FROM (
        SELECT CASE WHEN abs(x) > 433.4 THEN 1 WHEN abs(x) <= 433.4 THEN 0 END AS outside FROM al
        WHERE event_category = 'mouse' AND time >= 0) WHERE outside IS NOT NULL GROUP BY outside""",
        "al",
    ),
)
def a13_outside(spark, sf):
    from tracelane.operators.clean import flag_outside

    aligned = tr.align_trials(model_events(spark, sf), model_durations(spark, sf))
    return tr.outside_share(flag_outside(aligned))


# a term of the series of the lower incomplete gamma function
_TERM = "exp((chi.dof / 2.0 + i) * ln(chi.chi / 2.0) - chi.chi / 2.0 - lgamma(chi.dof / 2.0 + i + 1))"
_STRAT = f"""flags AS (SELECT participant, CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS stratum,
    include_ppt, {CRITERIA} FROM ppt),
long AS (UNPIVOT (SELECT stratum, include_ppt, CAST(criterion2_crittrials15 AS VARCHAR) AS c2,
    CAST(criterion3_attention_check2 AS VARCHAR) AS c3, bilingual2 FROM flags JOIN lang USING (participant))
    ON include_ppt, c2, c3, bilingual2 INTO NAME variable VALUE level),
cells AS (SELECT variable, level, stratum, count(*) AS n FROM long GROUP BY ALL),
exp AS (SELECT r.variable, r.level, s.stratum, r.n * s.n / CAST(t.n AS DOUBLE) AS e, coalesce(c.n, 0) AS o
    FROM (SELECT variable, level, sum(n) AS n FROM cells GROUP BY ALL) r
    JOIN (SELECT variable, stratum, sum(n) AS n FROM cells GROUP BY ALL) s ON s.variable = r.variable
    JOIN (SELECT variable, sum(n) AS n FROM cells GROUP BY ALL) t ON t.variable = r.variable
    LEFT JOIN cells c ON c.variable = r.variable AND c.level = r.level AND c.stratum = s.stratum),
chi AS (SELECT variable, (count(DISTINCT level) - 1) * (count(DISTINCT stratum) - 1) AS dof,
    CASE WHEN count(DISTINCT level) = 2 AND count(DISTINCT stratum) = 2
         THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(pow(o - e, 2) / e) END AS chi FROM exp
    GROUP BY variable)
SELECT exp.variable, exp.level, exp.stratum, exp.o AS n,
    {r6('100.0 * exp.o / sum(exp.o) OVER (PARTITION BY exp.variable, exp.stratum)')} AS percent,
    CASE WHEN chi.dof > 0 THEN {r6('chi.chi')} END AS chi_square, chi.dof AS dof,
    CASE WHEN chi.dof > 0 THEN CASE WHEN chi.chi <= 0 THEN 1.0 ELSE {r6(f"greatest(0.0, 1 - list_sum([{_TERM} for i in range(0, 2000)]))")}
    END END AS p
FROM exp JOIN chi ON chi.variable = exp.variable"""


@query("a14_stratified_table", statement("", "ppt").rstrip() + ",\n" + _STRAT)
def a14(spark, sf):
    flags = qu.inclusion_criteria_flags(model_participants(spark, sf), THRESHOLDS)
    named = flags.withColumnsRenamed(
        {"criterion2_crittrials15": "c2", "criterion3_attention_check2": "c3"}
    ).withColumn("cohort", F.when(F.col("participant") % 2 == 0, "Mturk").otherwise("LAB"))
    return agg.strat_table(named, "cohort", ["include_ppt", "c2", "c3", "bilingual2"])


@query(
    "a14_overall_table",
    f"""SELECT 'Overall' AS stratum, 'bilingual2' AS variable, c_mktsegment AS level, count(*) AS n,
    {r6('100.0 * count(*) / (SELECT count(*) FROM customer)')} AS percent FROM customer GROUP BY c_mktsegment""",
)
def a14_overall(spark, sf):
    answers = qu.questionnaire_answer(model_questionnaire(spark, sf), "language", "bilingual2")
    return agg.strat_table(answers, None, ["bilingual2"])


@query(
    "a15_invalidity_breakdown",
    statement(
        """SELECT cohort, rtval, clickval, datapoints, audio, count(*) AS n FROM (
        SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort,
        CASE WHEN clicktime >= 200 THEN 1 ELSE 0 END AS rtval, CASE WHEN clicked <> 'none' THEN 1 ELSE 0 END AS clickval,
        CASE WHEN datapoints <> 0 THEN 1 ELSE 0 END AS datapoints, audio_played AS audio FROM ti) GROUP BY ALL""",
        "ti",
    ),
)
def a15(spark, sf):
    return agg.invalidity_breakdown(co.union_cohorts(**two_cohorts(model_trials(spark, sf))))


@query(
    "a16_time_taken",
    statement(
        f"""SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort, {r6('median(time_taken)')}
        AS med_time, {r6('min(time_taken)')} AS min_time, {r6('max(time_taken)')} AS max_time FROM pi GROUP BY 1""",
        "pi",
    ),
)
def a16(spark, sf):
    ppt = co.union_cohorts(**two_cohorts(qu.participant_info(model_trials(spark, sf))))
    return agg.time_taken(ppt, ["cohort"])


@query(
    "a17_hour_histogram",
    statement(
        """SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort,
        CAST(hour(first_event) AS INTEGER) AS hourstart, count(*) AS n FROM (
        SELECT participant, min(epoch_ms(CAST(trial_start + elapsed AS BIGINT))) AS first_event FROM ev
        GROUP BY participant) GROUP BY 1, 2""",
        "ev",
    ),
)
def a17(spark, sf):
    """Hour of each participant's first event (trial starts all fall on midnight here)."""
    first = F.min(F.col("trial_start") + F.col("elapsed")).cast("long")
    ppt = model_events(spark, sf).groupBy("participant").agg(F.timestamp_millis(first).alias("first_time1"))
    return agg.hour_histogram(co.union_cohorts(**two_cohorts(ppt)), ["cohort"])


@query(
    "a18_choice_summary",
    statement(
        f"""SELECT trial_condition AS condition, {r6("count(*) FILTER (WHERE clicked = 'ref') / CAST(count(*) AS DOUBLE)")}
        AS refclicks, {r6('avg(clicktime)')} AS mean_rt FROM ti2 WHERE include_trial = 'valid' GROUP BY 1""",
        "ti2",
    ),
)
def a18(spark, sf):
    trials = qu.trial_inclusion(model_trials(spark, sf)).filter(F.col("include_trial") == "valid")
    return agg.choice_summary(trials.withColumnRenamed("trial_condition", "condition"))


@query(
    "a19_repeat_workers",
    statement(
        """SELECT mturk_id, count(*) AS nr_attempts, bool_or(regexp_matches(comments, 'URGENT [37]')) AS early
        FROM roster GROUP BY mturk_id HAVING count(*) > 1""",
        "roster",
    ),
)
def a19(spark, sf):
    return qu.repeat_workers(model_roster(spark, sf), "URGENT [37]")


@query(
    "a20_any_duplicate",
    statement(
        "SELECT count(*) > count(DISTINCT mturk_id) AS any_duplicate FROM roster WHERE batch = 'batch P'", "roster"
    ),
)
def a20(spark, sf):
    roster = model_roster(spark, sf)
    return agg.has_duplicates(roster.filter(F.col("batch") == "batch P"), "mturk_id")


@query(
    "w5_mark_duplicates",
    statement(
        """SELECT mturk_id, seq, row_number() OVER (PARTITION BY mturk_id ORDER BY seq) > 1 AS duplicate FROM roster""",
        "roster",
    ),
)
def w5(spark, sf):
    return agg.mark_duplicates(model_roster(spark, sf).select("mturk_id", "seq"), "mturk_id", "seq")


@query(
    "w7_series_start",
    statement(
        """SELECT participant, trial, seq, row_number() OVER (PARTITION BY participant, trial ORDER BY seq) = 1
        AS start_event FROM ev""",
        "ev",
    ),
)
def w7(spark, sf):
    return agg.series_start(model_events(spark, sf).select(*TRIAL, "seq"), TRIAL, "seq")


@query(
    "j1_attach_attention",
    statement(
        f"""SELECT e.participant, e.trial, e.seq, {r6('att.att_check')} AS att_check FROM att_ev e
        LEFT JOIN att ON att.participant = e.participant WHERE e.condition <> 'attention'""",
        "att_ev",
        "att",
    ),
)
def j1(spark, sf):
    events = with_attention_trials(model_events(spark, sf)).select(
        *TRIAL, "seq", "condition", "layer", "event_type", "image_right"
    )
    joined = tr.attach_attention(events, tr.attention_score(events))
    return joined.select(*TRIAL, "seq", "att_check")


@query(
    "j2_attach_onset",
    statement("SELECT participant, trial, seq, audio1_start FROM al", "al"),
)
def j2(spark, sf):
    from tracelane.operators.skew import attach_group_facts

    events = model_events(spark, sf).select(*TRIAL, "seq", "event_type", "elapsed")
    onset = F.min_by("elapsed", F.when(F.col("event_type") == "playbackstart", F.col("seq")))
    rows = attach_group_facts(events, TRIAL, [onset.alias("audio1_start")], ["seq"])
    return rows.select(*TRIAL, "seq", "audio1_start")


@query(
    "j3_duration_lookup",
    statement(
        """SELECT e.participant, e.trial, e.seq, d.audio1_duration FROM ev e
        LEFT JOIN dur d ON d.condition = e.condition AND d.item = e.trial""",
        "ev",
        "dur",
    ),
)
def j3(spark, sf):
    events = model_events(spark, sf).withColumn("item", F.col("trial"))
    rows = attach_durations(
        events.select(*TRIAL, "seq", "condition", "item"), model_durations(spark, sf), spread=["participant", "seq"]
    )
    return rows.select(*TRIAL, "seq", "audio1_duration")


@query(
    "j5_attach_choice",
    statement(
        """SELECT al.participant, al.trial, al.seq, oc.rt, oc.clicked FROM al LEFT JOIN oc
        ON oc.participant = al.participant AND oc.trial = al.trial AND oc.refpos = al.refpos""",
        "al",
        "oc",
    ),
)
def j5(spark, sf):
    events, durations = model_events(spark, sf), model_durations(spark, sf)
    choices = tr.object_choice_from_events(events, durations)
    rows = tr.attach_choice(
        events.select(*TRIAL, "refpos", "seq"), choices.select(*TRIAL, "refpos", "rt", "clicked"), events
    )
    return rows.select(*TRIAL, "seq", "rt", "clicked")


@query(
    "j7_right_join_answers",
    statement(
        """SELECT pi.participant, q.answer AS mturk_id FROM (SELECT * FROM qs WHERE question LIKE '%MTurk%') q
        RIGHT JOIN pi ON pi.participant = q.participant""",
        "qs",
        "pi",
    ),
)
def j7(spark, sf):
    ppt = qu.participant_info(model_trials(spark, sf)).select("participant")
    return qu.attach_worker(ppt, model_questionnaire(spark, sf))


@query("j8_attach_side_bias", SIDE_BIAS)
def j8(spark, sf):
    events = model_events(spark, sf)
    ppt = events.select("participant").distinct()
    return qu.attach_side_bias(ppt, tr.side_bias(events))


@query(
    "j12_attributes_on_trials",
    statement(
        """SELECT CASE WHEN ti.participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort, ti.participant, ti.trial,
        ppt.total_trials, ppt.bilingual2, ppt.include_ppt FROM ti LEFT JOIN ppt ON ppt.participant = ti.participant""",
        "ti",
        "ppt",
    ),
)
def j12(spark, sf):
    trials = co.union_cohorts(**two_cohorts(model_trials(spark, sf)))
    ppt = co.union_cohorts(**two_cohorts(model_participants(spark, sf)))
    person = ppt.select("cohort", "participant", "total_trials", "bilingual2", "include_ppt")
    joined = natural_join(trials, person, "left", ["cohort", "participant"], spread=["trial"])
    return joined.select("cohort", *TRIAL, "total_trials", "bilingual2", "include_ppt")


@query(
    "j13_membership_flag",
    statement(
        """SELECT participant, mturk_id, mturk_id IN (SELECT mturk_id FROM roster) AS submitted FROM ppt""",
        "ppt",
        "roster",
    ),
)
def j13(spark, sf):
    answers = qu.questionnaire_answer(model_questionnaire(spark, sf), "MTurk", "mturk_id")
    ppt = natural_join(
        model_events(spark, sf).select("participant").distinct(), answers, "left", ["participant"], null_safe=False
    )
    return membership_flag(ppt, "mturk_id", model_roster(spark, sf), "mturk_id", "submitted", ["participant"])


@query(
    "j16_natural_join_null_keys",
    statement(
        """SELECT c.participant, c.trial, c.seq, m.n FROM client c LEFT JOIN (
        SELECT participant, image_left, count(*) AS n FROM client GROUP BY participant, image_left) m
        ON m.participant = c.participant AND m.image_left IS NOT DISTINCT FROM c.image_left""",
        "client",
    ),
)
def j16(spark, sf):
    events = with_client_columns(model_events(spark, sf)).select(*TRIAL, "seq", "image_left")
    counts = events.groupBy("participant", "image_left").agg(F.count(F.lit(1)).alias("n"))
    return natural_join(events, counts, spread=["seq"]).select(*TRIAL, "seq", "n")


@query(
    "p1_coalesce_shifted",
    statement(
        """SELECT participant, seq, coalesce(image_left, browser) AS image_left,
        coalesce(image_right, version) AS image_right, coalesce(audio, os) AS audio FROM client""",
        "client",
    ),
)
def p1(spark, sf):
    rows = coalesce_shifted(with_client_columns(model_events(spark, sf)))
    return rows.select("participant", "seq", "image_left", "image_right", "audio")


@query(
    "p15_status_label",
    statement(
        """SELECT participant, coalesce(include_ppt, 'NA') || ' : ' || bilingual2 || ' : ' || total_trials AS label
        FROM ppt""",
        "ppt",
    ),
)
def p15(spark, sf):
    from tracelane.operators.clean import status_label

    rows = status_label(model_participants(spark, sf), ["include_ppt", "bilingual2", "total_trials"], name="label")
    return rows.select("participant", "label")


@query(
    "attention_by_participant_join",
    statement(
        f"SELECT pi.participant, pi.total_trials, {r6('att.att_check')} AS att_check FROM pi "
        "LEFT JOIN att ON att.participant = pi.participant",
        "pi",
        "att",
    ),
)
def attention_join(spark, sf):
    ppt = qu.participant_info(model_trials(spark, sf)).select("participant", "total_trials")
    return natural_join(ppt, model_attention(spark, sf).drop("att_checkn"), "left", ["participant"], null_safe=False)


@query(
    "x11_first_match",
    statement(
        """SELECT mturk_id, min(nth) FILTER (WHERE ok) AS first_index, min(seq) FILTER (WHERE ok) AS first_value FROM (
        SELECT mturk_id, seq, batch = 'batch F' AS ok, row_number() OVER (PARTITION BY mturk_id ORDER BY seq) AS nth
        FROM roster) GROUP BY mturk_id""",
        "roster",
    ),
)
def x11(spark, sf):
    roster = model_roster(spark, sf).select("mturk_id", "seq", "batch")
    return agg.first_index(roster, ["mturk_id"], F.col("batch") == "batch F", "seq", "seq")

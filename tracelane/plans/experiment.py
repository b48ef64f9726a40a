"""The complete analyses: one cohort's tables from raw files, and the merged analysis of two cohorts."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions import matches
from tracelane.operators.aggregate import (
    choice_summary,
    freq_table,
    hour_histogram,
    invalidity_breakdown,
    strat_table,
    time_taken,
    timecourse,
)
from tracelane.operators.clean import coalesce_shifted, parse_condition, recentre
from tracelane.operators.cohort import analysis_population, cohort_exclusion, merge_cohorts
from tracelane.operators.model import bias_columns, fitted_timecourse, model_frame, subject_slopes
from tracelane.operators.quality import (
    Thresholds,
    attach_questionnaire,
    attach_side_bias,
    attach_worker,
    enrich,
    inclusion_criteria_flags,
    participant_inclusion,
    participant_info,
    resolve_duplicates,
    trial_inclusion,
)
from tracelane.operators.resample import STEP_MS, heavy_grids, trajectories
from tracelane.operators.trials import (
    attach_attention,
    attention_score,
    object_choice_from_events,
    side_bias,
    trial_info,
)
from tracelane.sources import read_table, write_table

# fixed value: the participant whose log is unusable
EXCLUDED_PARTICIPANT = 251


@dataclass
class CohortTables:
    """What one cohort's processing yields."""

    ppt_info: DataFrame
    ppt_trial_info: DataFrame
    tdat_binned: DataFrame
    object_clicks: DataFrame

    def stored(self, spark: SparkSession, folder: str) -> "CohortTables":
        """Write every table below ``folder`` and go on from the files."""
        kept = {}
        for f in fields(self):
            path = f"{folder}/{f.name}"
            write_table(getattr(self, f.name), path)
            kept[f.name] = read_table(spark, path)
        return CohortTables(**kept)


def clean_events(raw: DataFrame) -> DataFrame:
    """Repair shifted columns, drop the unusable log, centre positions, split condition codes.

    Attention trials keep their own code and are told apart by it.
    """
    kept = coalesce_shifted(raw).filter(F.col("participant") != EXCLUDED_PARTICIPANT)
    return recentre(kept)


def experimental_events(cleaned: DataFrame) -> DataFrame:
    """Events of the experimental trials with the participant's attention score."""
    return parse_condition(attach_attention(cleaned, attention_score(cleaned)))


def build_cohort(
    events: DataFrame,
    questions: DataFrame,
    durations: DataFrame,
    roster: DataFrame | None = None,
    *,
    step: int = STEP_MS,
    fill_scope: str = "trial",
    thresholds: Thresholds = Thresholds(),
    keys: str = "explicit",
    store: str | None = None,
) -> CohortTables:
    """All tables of one cohort from its cleaned raw events (see ``clean_events``).

    The attention score is a participant attribute, so it joins the participant table rather than every
    event.  With ``store`` the per-trial and per-participant tables are written there first, so that the
    large tables built on them read them instead of deriving them again.
    """
    spark = events.sparkSession
    score = attention_score(events)
    trial_rows = parse_condition(events.filter(~matches("condition", "attention")))

    trials = trial_info(trial_rows, durations)
    trials = trials.join(score.select("participant", "att_check"), "participant", "left")
    trials = trial_inclusion(trials)
    if store:
        write_table(trials, f"{store}/trials")
        trials = read_table(spark, f"{store}/trials")
    ppt = attach_questionnaire(participant_info(trials), questions)
    ppt = attach_side_bias(ppt, side_bias(trial_rows))
    if roster is None:
        ppt = participant_inclusion(ppt, thresholds).withColumn("duplicate2", F.lit("n-dup"))
    else:
        ppt = resolve_duplicates(participant_inclusion(attach_worker(ppt, questions), thresholds), roster)
    if store:
        write_table(ppt, f"{store}/participants")
        ppt = read_table(spark, f"{store}/participants")

    binned = trajectories(trial_rows, durations, step, fill_scope).filter(F.col("condition") != "Filler")
    clicks = object_choice_from_events(trial_rows, durations).filter(F.col("fluency") != "Filler")
    return CohortTables(
        ppt_info=ppt,
        ppt_trial_info=trials,
        tdat_binned=enrich(binned, ppt, trials, keys, ["bin"], heavy_grids(trial_rows, durations, step)),
        object_clicks=enrich(clicks, ppt, trials, keys, ["participant"]),
    )


def merge_analysis(mturk: CohortTables, lab: CohortTables) -> CohortTables:
    """Union of the cohorts without pilot and incomplete sessions, restricted to nobody yet."""
    ppt = merge_cohorts(Mturk=mturk.ppt_info, LAB=lab.ppt_info)
    trials = merge_cohorts(F.lit(True), Mturk=mturk.ppt_trial_info, LAB=lab.ppt_trial_info)
    person = ["total_trials", "bilingual2", "duplicate2", "include_ppt"]
    attributes = merge_cohorts(F.lit(True), Mturk=mturk.ppt_info, LAB=lab.ppt_info)
    trials = trials.join(attributes.select("cohort", "participant", *person), ["cohort", "participant"], "left")
    return CohortTables(
        ppt_info=ppt,
        ppt_trial_info=trials.filter(cohort_exclusion()),
        tdat_binned=merge_cohorts(Mturk=mturk.tdat_binned, LAB=lab.tdat_binned),
        object_clicks=merge_cohorts(Mturk=mturk.object_clicks, LAB=lab.object_clicks),
    )


def analysis_reports(merged: CohortTables, step: int = STEP_MS, max_ms: float = 5000) -> dict[str, DataFrame]:
    """Every table and plot frame of the merged analysis, each as a lazy DataFrame."""
    flags = inclusion_criteria_flags(merged.ppt_info)
    criteria = [c for c in flags.columns if "criterion" in c]
    first_time = F.col("duplicate2") == "n-dup"
    monolingual = flags.filter((F.col("bilingual2") == "Monolingual") & first_time)
    chosen = analysis_population()
    trials = merged.ppt_trial_info.filter(chosen)
    ppt = merged.ppt_info.filter(chosen)
    binned = merged.tdat_binned.filter(chosen)
    clicks = merged.object_clicks.filter(chosen)
    valid = binned.filter(F.col("include_trial") == "valid")
    answered = clicks.filter((F.col("clicked") != "none") & (F.col("rt") >= 200))
    by = ["condition", "cohort"]
    frame = model_frame(binned)
    cell = ["fluency", "cohort"]
    slopes = subject_slopes(frame, "elog_bias", "time_z", cell)
    return {
        "language": strat_table(
            flags.filter((F.col("cohort") == "Mturk") & first_time), None, ["bilingual2"]
        ),
        "criteria": strat_table(monolingual, "cohort", criteria),
        "inclusion": strat_table(monolingual, "cohort", ["include_ppt"]),
        "invalid_trials": invalidity_breakdown(trials),
        "time_taken": time_taken(ppt, ["cohort"]),
        "hours": hour_histogram(ppt, ["cohort"]),
        "movement": timecourse(
            binned.filter(F.col("time") <= max_ms), ["refprop", "disprop"], "participant", by, interval=step
        ),
        "bias": timecourse(
            bias_columns(valid), ["moveo", "elog_bias"], "participant", by, interval=step
        ),
        "choices": choice_summary(
            clicks.filter(F.col("include_trial") == "valid").withColumnRenamed("trial_condition", "condition")
        ),
        "clicked": freq_table(answered, ["clicked"]),
        "clicked_by_fluency": freq_table(answered, ["fluency", "clicked"], ["fluency"]),
        "slopes": slopes,
        "fitted": fitted_timecourse(frame, slopes, cell, interval=step),
    }

"""Participant summaries, inclusion rules and repeated participation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions import (
    epoch_ms_to_ts,
    if_else,
    matches,
    minutes_between,
    recode,
    strict_max,
)
from tracelane.operators.clean import status_label
from tracelane.operators.joins import natural_join
from tracelane.operators.skew import hot_keys, salted_left_join

# fixed values: language answers of the questionnaire versions and their groups
LANGUAGE_GROUPS = {
    "No": "Monolingual",
    "No - Only English": "Monolingual",
    "Yes - English and some other language": "Bilingual",
    "Yes - Some other language and not English": "Non-native",
    "Yes": "maybe",
}
# fixed values: completion codes of the batches run before worker ids were logged
EARLY_CODES = "GREENBERG|TWAIN"
# fixed value: 2000-01-01 in epoch seconds, compared as written with millisecond stamps
CLOCK_FLOOR = 946684800


@dataclass(frozen=True)
class Thresholds:
    """Inclusion criteria (defaults: the study's)."""

    min_trials: int = 55
    min_critical: int = 10
    min_attention: float = 0.5
    max_early_percent: float = 10
    min_left: float = 0.1
    max_left: float = 0.9
    min_click_ms: float = 200


def participant_info(trials: DataFrame, clock_floor: int = CLOCK_FLOOR, client=("browser", "version", "os")) -> DataFrame:
    """One row per participant from one row per trial.

    Trials are unique rows here, so the distinct-trial counts are plain conditional counts.
    """
    n = F.count(F.lit(1))
    moved = F.col("datapoints") != 0
    critical = F.col("trial_condition") != "Filler"
    early = (
        F.col("clicked").isNotNull() & moved & ((F.col("clicktime") <= 0) | (F.col("audio_played") == 0))
    )
    # an unknown start makes both ends unknown
    start = F.col("trialstart")
    known = F.count(start) == n
    first = F.when(known, F.min(F.when(start > clock_floor, start)))
    extra = [F.max("att_check").alias("att_check")] if "att_check" in trials.columns else []
    ppt = trials.groupBy("participant").agg(
        n.alias("total_trials"),
        F.count_if(F.col("datapoints") == 0).alias("empty_trials"),
        F.count_if(critical).alias("crit_trials"),
        F.count_if(critical & moved).alias("crit_nonempty_trials"),
        *extra,
        F.count_if(early).alias("n_clickprenoun_nonempty"),
        F.avg("clicktime").alias("avg_clicktime"),
        epoch_ms_to_ts(first).alias("first_time1"),
        epoch_ms_to_ts(strict_max(start)).alias("last_time"),
        *[F.min_by(c, "trial").alias(c) for c in client],
    )
    return ppt.withColumns(
        {
            "p_clickprenoun_nonempty": F.col("n_clickprenoun_nonempty") / F.col("total_trials") * 100,
            "time_taken": minutes_between("first_time1", "last_time"),
        }
    )


def questionnaire_answer(
    questions: DataFrame, pattern: str, name: str, seq: str | Column = "seq"
) -> DataFrame:
    """First answer of each participant to the question that matches ``pattern``."""
    rows = questions.filter(matches("question", pattern))
    return rows.groupBy("participant").agg(F.min_by("answer", seq).alias(name))


def attach_answers(ppt: DataFrame, answers: DataFrame) -> DataFrame:
    """All participants, with their answer when there is one (the flipped form of a right join)."""
    return natural_join(answers, ppt, "right", ["participant"], null_safe=False)


def attach_questionnaire(
    ppt: DataFrame, questions: DataFrame, groups: dict[str, str] = LANGUAGE_GROUPS
) -> DataFrame:
    """Language answer (``bilingual``) and its group (``bilingual2``) per participant."""
    language = questionnaire_answer(questions, "language", "bilingual")
    language = language.withColumn("bilingual2", recode("bilingual", groups))
    return attach_answers(ppt, language)


def attach_worker(ppt: DataFrame, questions: DataFrame) -> DataFrame:
    return attach_answers(ppt, questionnaire_answer(questions, "MTurk", "mturk_id"))


def _valid(t: Thresholds) -> dict[str, Column]:
    left = F.col("lside_clicks")
    return {
        "criterion1_total_trials55": F.col("total_trials") >= t.min_trials,
        "criterion2_crittrials15": F.col("crit_nonempty_trials") >= t.min_critical,
        "criterion3_attention_check2": F.col("att_check") >= t.min_attention,
        "criterion4_pclick10": F.col("p_clickprenoun_nonempty") <= t.max_early_percent,
        "criterion5_Lsideclicks10": (left >= t.min_left) & (left <= t.max_left),
        "criterion6_avgclicktime200": F.col("avg_clicktime") >= t.min_click_ms,
    }


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def participant_inclusion(ppt: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``include_ppt``: valid, invalid, or null when an unknown criterion decides."""
    met = _all(list(_valid(thresholds).values()))
    return ppt.withColumn("include_ppt", if_else(met, F.lit("valid"), F.lit("invalid")))


def inclusion_criteria_flags(ppt: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The six criteria as separate 0/1 columns."""
    return ppt.withColumns({k: if_else(c, F.lit(1), F.lit(0)) for k, c in _valid(thresholds).items()})


def trial_inclusion(trials: DataFrame, min_click_ms: float = 200) -> DataFrame:
    """``include_trial``: cursor moved, an object was clicked late enough, and audio played."""
    met = _all(
        [
            F.col("datapoints") != 0,
            F.col("clicked") != "none",
            F.col("clicktime") >= min_click_ms,
            F.col("clicktime").isNotNull(),
            F.col("audio_played") == 1,
        ]
    )
    return trials.withColumn("include_trial", if_else(met, F.lit("valid"), F.lit("invalid")))


def repeat_workers(roster: DataFrame, early: str = EARLY_CODES) -> DataFrame:
    """Workers with more than one submission and whether any comment names an early batch."""
    return (
        roster.groupBy("mturk_id")
        .agg(
            F.count(F.lit(1)).alias("nr_attempts"),
            F.bool_or(matches("comments", early)).alias("early"),
        )
        .filter(F.col("nr_attempts") > 1)
    )


def resolve_duplicates(ppt: DataFrame, roster: DataFrame, early: str = EARLY_CODES) -> DataFrame:
    """Label repeated participation.

    ``duplicate``: by the roster.  ``duplicate2``: as that, but the first participation with at least one
    trial counts as original unless the worker already took part in an early batch.  ``submitted``: does the
    worker occur in the roster at all?  Everything about a worker is a map-side combined aggregate; the
    participations themselves meet it in one join.
    """
    submissions = roster.groupBy("mturk_id").agg(
        (F.count(F.lit(1)) > 1).alias("__repeat"), F.bool_or(matches("comments", early)).alias("__early")
    )
    known = F.col("mturk_id").isNotNull()
    workers = (
        ppt.filter(known)
        .groupBy("mturk_id")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min(F.when(F.col("total_trials") >= 1, F.col("participant"))).alias("__first"),
        )
        .join(submissions, "mturk_id", "left")
    )
    marked = salted_left_join(ppt, workers, ["mturk_id"], ["participant"], hot_keys(ppt, ["mturk_id"]))
    repeat = F.coalesce(F.col("__repeat"), F.lit(False))
    early_worker = repeat & F.coalesce(F.col("__early"), F.lit(False))
    original = (F.col("__n") > 1) & ~early_worker & (F.col("participant") == F.col("__first"))
    duplicate = F.when(repeat, "duplicate").when(known, "n-dup").otherwise("unknown")
    kept = repeat & F.coalesce(original, F.lit(False))
    submitted = F.when(F.col("__repeat").isNotNull(), "submitted").otherwise("not submitted")
    marked = marked.withColumns(
        {
            "duplicate": duplicate,
            "duplicate2": F.when(kept, "n-dup").otherwise(duplicate),
            "submitted": F.when(known, submitted),
        }
    )
    return status_label(marked.drop("__repeat", "__early", "__n", "__first"), ["include_ppt", "duplicate2"])


def attach_side_bias(ppt: DataFrame, bias: DataFrame) -> DataFrame:
    return natural_join(ppt, bias, "left", ["participant"], null_safe=False)


def enrich(
    rows: DataFrame,
    ppt: DataFrame,
    trials: DataFrame,
    keys: str = "explicit",
    spread: list[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Participant and trial attributes on every row of a large table.

    ``explicit``: the two small tables are joined with each other first, so the large one is joined once,
    on (participant, trial).  ``natural``: two joins on all shared columns, null matching null, as written
    in the analyses - rows whose client columns differ from the participant's get no trial attributes.
    ``hot`` may give the trials that are heavy in ``rows``, which are counted otherwise.
    """
    if keys == "natural":
        by = spread or rows.columns
        return natural_join(natural_join(rows, ppt, spread=by), trials, spread=by)
    if keys != "explicit":
        raise ValueError(f"unknown keys {keys!r}")
    on = ["participant", "trial"]
    person = natural_join(trials, ppt, "left", ["participant"], null_safe=False, spread=["trial"])
    added = person.select(*on, *[c for c in person.columns if c not in rows.columns])
    return salted_left_join(rows, added, on, spread or rows.columns, hot)

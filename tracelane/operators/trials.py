"""Per-trial and per-participant facts from raw events, and the onset-aligned clock.

One row per trial is always derived by a single map-side combined aggregate.  Raw events are joined to
those rows at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions import (
    any_equal,
    click_side,
    first_where,
    last_where,
    matches,
    object_chosen,
    share_where,
)
from tracelane.operators.joins import attach_durations
from tracelane.operators.skew import hot_keys, salted_left_join

TRIAL = ["participant", "trial"]


def is_click() -> Column:
    return F.col("event_type") == "click"


def _last_click(value: str | Column) -> Column:
    return last_where(value, is_click(), "seq")


def _click_side_code() -> Column:
    """Side of the last click as a number (0 none, 1 left, 2 right).

    With numbers in its state the aggregate hashes; text would make Spark sort the raw events first.
    """
    side = click_side("layer")
    code = F.when(side == "L", 1).when(side == "R", 2).otherwise(0)
    return F.coalesce(_last_click(code), F.lit(0))


def _side_name(code: str) -> Column:
    return F.when(F.col(code) == 1, "L").when(F.col(code) == 2, "R").otherwise("none")


def attention_score(events: DataFrame) -> DataFrame:
    """Number and share of attention trials answered on the correct side, per participant."""
    trials = (
        events.filter(F.col("condition") == "attention")
        .groupBy(*TRIAL)
        .agg(
            _click_side_code().alias("side"),
            first_where(matches("image_right", "atta"), None, "seq").alias("animal_right"),
        )
    )
    correct = F.when(F.col("animal_right"), 2).otherwise(1)
    return (
        trials.withColumn("hit", F.col("side") == correct)
        .groupBy("participant")
        .agg(F.count(F.lit(1)).alias("att_checkn"), share_where(F.col("hit")).alias("att_check"))
    )


def drop_attention(events: DataFrame) -> DataFrame:
    return events.filter(~matches("condition", "attention"))


def attach_attention(events: DataFrame, score: DataFrame) -> DataFrame:
    """Experimental events with the attention score of their participant (null without one)."""
    return salted_left_join(drop_attention(events), score, ["participant"], ["seq"])


def side_bias(events: DataFrame) -> DataFrame:
    """Share of trials whose last click was on the left and on the right image."""
    trials = events.groupBy(*TRIAL).agg(_click_side_code().alias("side"))
    return trials.groupBy("participant").agg(
        share_where(F.col("side") == 1).alias("lside_clicks"),
        share_where(F.col("side") == 2).alias("rside_clicks"),
    )


def _first_known(c: str) -> Column:
    """First value that is known, over rows that carry the place of their first event (``__first``)."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__first"))).alias(c)


def trial_onsets(events: DataFrame, also: tuple[str, ...] = ("condition", "refpos")) -> DataFrame:
    """One row per trial: start of its first audio, and the first known value of what belongs to the trial.

    Texts are grouping columns of a first aggregate, whose state is numbers only, so that the raw events are hashed
    and not sorted; of a trial with several values the second one, over about a row per trial, takes the first.
    """
    playback = F.col("event_type") == "playbackstart"
    parts = events.groupBy(*TRIAL, *also).agg(
        F.min("seq").alias("__first"),
        F.min(F.when(playback, F.col("seq"))).alias("__onset"),
        first_where("elapsed", playback, "seq").alias("audio1_start"),
        F.min("elapsed").alias("first_elapsed"),
        F.max("elapsed").alias("last_elapsed"),
    )
    return parts.groupBy(*TRIAL).agg(
        *[_first_known(c) for c in also],
        F.min_by("audio1_start", "__onset").alias("audio1_start"),
        F.min("first_elapsed").alias("first_elapsed"),
        F.max("last_elapsed").alias("last_elapsed"),
    )


def trial_clock(
    events: DataFrame, durations: DataFrame, also: tuple[str, ...] = ("condition", "refpos")
) -> DataFrame:
    """One row per trial: when its first recording ends, i.e. the zero of the aligned clock."""
    onsets = trial_onsets(events, also).withColumn("item", F.col("trial"))
    timed = attach_durations(onsets, durations)
    return timed.withColumn("audio1_end", F.col("audio1_start") + F.col("audio1_duration"))


def align_trials(events: DataFrame, durations: DataFrame, keep_slice: bool = False) -> DataFrame:
    """Every event with ``time`` = milliseconds since the referent's onset.

    A trial may hold any share of all events: heavy trials are counted on the bare events and spread
    over several sub-keys for the join.
    """
    clock = trial_clock(events, durations, also=("condition",)).select(
        *TRIAL, "item", "audio1_start", "audio1_duration", "audio1_end"
    )
    hot = hot_keys(events, TRIAL)
    joined = salted_left_join(events, clock, TRIAL, ["seq"], hot, keep_slice=keep_slice)
    return joined.withColumn("time", F.col("elapsed") - F.col("audio1_end"))


def object_choice(aligned: DataFrame) -> DataFrame:
    """Which object the last click of each trial chose, and when."""
    trials = aligned.groupBy(*TRIAL).agg(
        first_where("condition", None, "seq").alias("fluency"),
        first_where("refpos", None, "seq").alias("refpos"),
        _last_click("time").alias("rt"),
        _last_click("layer").alias("clicked_lr"),
    )
    return trials.withColumn("clicked", object_chosen(click_side("clicked_lr"), "refpos"))


def object_choice_from_events(events: DataFrame, durations: DataFrame) -> DataFrame:
    """``object_choice`` without aligning every event: only the last click of a trial is timed."""
    facts = (
        events.groupBy(*TRIAL)
        .agg(
            first_where("condition", None, "seq").alias("condition"),
            first_where("refpos", None, "seq").alias("refpos"),
            first_where("elapsed", F.col("event_type") == "playbackstart", "seq").alias("audio1_start"),
            _last_click("elapsed").alias("click_elapsed"),
            _last_click("layer").alias("clicked_lr"),
        )
        .withColumn("item", F.col("trial"))
    )
    timed = attach_durations(facts, durations)
    rt = F.col("click_elapsed") - (F.col("audio1_start") + F.col("audio1_duration"))
    chosen = object_chosen(click_side("clicked_lr"), "refpos")
    return timed.select(
        *TRIAL, F.col("condition").alias("fluency"), "refpos", rt.alias("rt"), "clicked_lr", chosen.alias("clicked")
    )


def attach_choice(aligned: DataFrame, choices: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Aligned events with the outcome of their trial (joined on trial and referent side).

    ``events``: the rows ``aligned`` was made from, on which heavy trials are cheaper to count.
    """
    keys = [*TRIAL, "refpos"]
    hot = hot_keys(aligned if events is None else events, keys)
    return salted_left_join(aligned, choices, keys, ["seq"], hot, null_safe=True)


# client columns are reported as they stand on a trial's first row
CLIENT = ("browser", "version", "os")


def trial_info(events: DataFrame, durations: DataFrame, client: tuple[str, ...] = CLIENT) -> DataFrame:
    """One row per trial: start, whether audio played, amount of movement, click time and choice.

    Condition and referent side are the first known ones, client columns those of the first row.  As in
    ``trial_onsets``, all of them are grouping columns of a first, numeric aggregate.
    """
    texts = ["condition", "refpos", *client]
    att = [c for c in ("att_check",) if c in events.columns]
    playback = F.col("event_type") == "playbackstart"
    side = click_side("layer")
    code = F.when(side == "L", 1).when(side == "R", 2).otherwise(0)
    parts = events.groupBy(*TRIAL, *texts).agg(
        F.min("seq").alias("__first"),
        F.min(F.when(playback, F.col("seq"))).alias("__onset"),
        F.max(F.when(is_click(), F.col("seq"))).alias("__click"),
        first_where("trial_start", None, "seq").alias("trialstart"),
        any_equal("event_type", "playbackstart").alias("audio_played"),
        F.count_if(F.col("event_type") == "move").alias("datapoints"),
        first_where("elapsed", playback, "seq").alias("audio1_start"),
        _last_click("elapsed").alias("click_elapsed"),
        _last_click(code).alias("side"),
        *[first_where(c, None, "seq").alias(c) for c in att],
    )
    facts = parts.groupBy(*TRIAL).agg(
        *[_first_known(c) for c in ("condition", "refpos")],
        F.min_by("trialstart", "__first").alias("trialstart"),
        F.max("audio_played").alias("audio_played"),
        F.sum("datapoints").alias("datapoints"),
        F.min_by("audio1_start", "__onset").alias("audio1_start"),
        F.max_by("click_elapsed", "__click").alias("click_elapsed"),
        F.coalesce(F.max_by("side", "__click"), F.lit(0)).alias("side"),
        *[F.min_by(c, "__first").alias(c) for c in [*client, *att]],
    )
    facts = facts.withColumn("item", F.col("trial"))
    timed = attach_durations(facts, durations)
    clicktime = F.col("click_elapsed") - (F.col("audio1_start") + F.col("audio1_duration"))
    return timed.select(
        *TRIAL,
        "trialstart",
        "audio_played",
        "datapoints",
        clicktime.alias("clicktime"),
        *att,
        object_chosen(_side_name("side"), "refpos").alias("clicked"),
        F.col("condition").alias("trial_condition"),
        *client,
    )


def outside_share(aligned: DataFrame) -> DataFrame:
    """How many cursor samples after the onset lie beyond the images' outer edge."""
    from tracelane.operators.aggregate import freq_table

    return freq_table(aligned.filter((F.col("event_category") == "mouse") & (F.col("time") >= 0)), ["outside"])

"""The invented trial of the fixture notes and its edge cases, through the whole trial chain."""

import pytest
from pyspark.sql import functions as F

from tracelane.operators import resample as rs
from tracelane.operators import skew
from tracelane.operators import trials as tr

SCHEMA = (
    "participant long, trial string, seq long, condition string, refpos string, event_category string, "
    "event_type string, layer string, x double, y double, elapsed double, trial_start long"
)
DURATIONS = "condition string, item string, audio1_duration double"
FEATURES = ["bin", "x", "distance_travelled", "cumulative_distance", "ref_cdist", "dis_cdist", "refprop", "disprop"]


def event(trial, seq, kind, elapsed, x=None, layer=None, participant=1, refpos="L", condition="Fluent"):
    category = "audio" if kind == "playbackstart" else "mouse"
    y = None if x is None else 0.0
    return (participant, trial, seq, condition, refpos, category, kind, layer, x, y, float(elapsed), 5_000)


LAMP = [
    event("lamp", 1, "playbackstart", 1000),
    event("lamp", 2, "move", 1990, 0.0),
    event("lamp", 3, "move", 2010, -10.0),
    event("lamp", 4, "move", 2050, -5.0),
    event("lamp", 5, "click", 2300, -112.0, "image-left"),
]
# no audio: no clock, so no grid rows; the last click has no layer
MUTE = [
    event("mute", 6, "move", 100, 3.0),
    event("mute", 7, "click", 150, 4.0, "image-left"),
    event("mute", 8, "click", 160, 4.0, None),
]
# first position only after time 0, one unknown position in between
LATE = [
    event("zoo", 9, "playbackstart", 0),
    event("zoo", 10, "move", 1060, 10.0),
    event("zoo", 11, "move", 1100, None),
    event("zoo", 12, "move", 1120, 30.0),
    event("zoo", 13, "click", 1140, 20.0, "image-right"),
]
# the grid starts after time 0
SHORT = [
    event("pin", 20, "playbackstart", 1990, participant=2, refpos="R"),
    event("pin", 21, "move", 3000, 1.0, participant=2, refpos="R"),
    event("pin", 22, "move", 3040, 6.0, participant=2, refpos="R"),
    event("pin", 23, "click", 3080, 3.0, "image-right", participant=2, refpos="R"),
]
ALL = LAMP + MUTE + LATE + SHORT


@pytest.fixture
def events(spark):
    return spark.createDataFrame(ALL, SCHEMA)


@pytest.fixture
def durations(spark):
    items = [("Fluent", i, 1000.0) for i in ("lamp", "mute", "zoo", "pin")]
    return spark.createDataFrame(items, DURATIONS)


def stepwise(events, durations, scope="trial"):
    grid = rs.resample(tr.align_trials(events, durations), 20, scope)
    constant = events.select("participant", "trial", "condition", "refpos").distinct()
    rows = rs.movement_features(grid.join(constant, ["participant", "trial"], "left"))
    return rows.select("participant", "trial", "condition", "refpos", "bin", "time", "x", "y", *rs.FEATURES)


def by_bin(df, trial):
    return {r.bin: tuple(r)[1:] for r in df.filter(F.col("trial") == trial).select(*FEATURES).collect()}


def test_worked_example(events, durations):
    got = by_bin(rs.trajectories(events, durations), "lamp")
    assert sorted(got) == list(range(16))
    assert got[0] == (-5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[1] == (-5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[15] == (-112.0, -107.0, 107.0, 107.0, 0.0, 1.0, 0.0)


def test_unknown_start_makes_distances_unknown(events, durations):
    got = by_bin(rs.trajectories(events, durations), "zoo")
    # the grid runs from the audio row (time -1000) but is kept from 0 on
    assert sorted(got) == list(range(8))
    assert got[0] == (None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[1][1:] == (None,) * 6
    assert got[3] == (10.0, None, None, None, None, None, None)
    assert got[5] == (10.0, 0.0, None, None, None, None, None)
    assert got[6] == (30.0, 20.0, None, None, None, None, None)


def test_fill_from_the_previous_trial(events, durations):
    got = by_bin(rs.trajectories(events, durations, fill_scope="participant"), "zoo")
    # "lamp" ended at -112 and stands until the first position of "zoo"
    assert got[0] == (-112.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[3] == (10.0, 122.0, 122.0, 0.0, 122.0, 0.0, 1.0)
    assert got[7] == (20.0, -10.0, 152.0, 10.0, 142.0, 10 / 152, 142 / 152)


def test_first_row_after_time_zero_keeps_unknown_distances(spark, durations):
    # mouse rows only, the first one after the onset
    late = [e for e in SHORT if e[6] != "playbackstart"]
    rows = spark.createDataFrame(late, SCHEMA).withColumn("time", F.col("elapsed") - 2990)
    grid = rs.resample(rows, 20).withColumns({"refpos": F.lit("R"), "condition": F.lit("Fluent")})
    got = by_bin(rs.movement_features(grid), "pin")
    assert sorted(got) == [0, 1, 2, 3, 4]
    shifted = rows.withColumn("time", F.col("time") + 100)
    grid = rs.resample(shifted, 20).withColumns({"refpos": F.lit("R"), "condition": F.lit("Fluent")})
    got = by_bin(rs.movement_features(grid), "pin")
    assert sorted(got) == [6, 7, 8, 9, 10]
    assert got[6] == (1.0, None, None, None, None, None, None)
    assert got[8] == (6.0, 5.0, 5.0, 5.0, 0.0, 1.0, 0.0)


@pytest.mark.parametrize("scope, block", [("trial", 1), ("trial", 3), ("participant", 2)])
def test_fused_and_stepwise_agree_for_any_block_size(events, durations, rows, monkeypatch, scope, block):
    want = rows(stepwise(events, durations, scope))
    monkeypatch.setattr(skew, "BLOCK", block)
    assert rows(rs.trajectories(events, durations, fill_scope=scope)) == want
    assert rows(stepwise(events, durations, scope)) == want


def test_heavy_trials_give_the_same_rows(events, durations, rows, monkeypatch):
    want = rows(rs.trajectories(events, durations))
    aligned = rows(tr.align_trials(events, durations), "participant", "trial", "seq", "time")
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    assert rows(rs.trajectories(events, durations)) == want
    assert rows(tr.align_trials(events, durations), "participant", "trial", "seq", "time") == aligned


def test_row_order_does_not_matter(spark, events, durations, rows):
    shuffled = spark.createDataFrame(ALL[::-1][3:] + ALL[::-1][:3], SCHEMA).repartition(3)
    assert rows(rs.trajectories(shuffled, durations)) == rows(rs.trajectories(events, durations))
    assert rows(tr.object_choice_from_events(shuffled, durations)) == rows(
        tr.object_choice_from_events(events, durations)
    )


def test_a_trial_with_several_conditions_keeps_its_rows(spark, durations):
    some = spark.createDataFrame(ALL, SCHEMA)
    mixed = some.withColumn("condition", F.when(F.col("seq") % 2 == 0, F.col("condition")))
    aligned = tr.align_trials(mixed, durations)
    assert aligned.count() == some.count()
    assert tr.trial_onsets(mixed).count() == some.select("participant", "trial").distinct().count()


def test_invariants_on_shared_data(spark):
    from tracelane.plans.driver_tables import model_trajectories

    df = model_trajectories(spark, "/root/testdata/sf0.001").cache()
    known = df.filter(F.col("cumulative_distance").isNotNull())
    total = F.col("refprop") + F.col("disprop")
    assert known.filter((F.abs(total) > 1e-9) & (F.abs(total - 1) > 1e-9)).count() == 0
    gap = F.abs(F.col("ref_cdist") + F.col("dis_cdist") - F.col("cumulative_distance"))
    assert known.filter(gap > 1e-6).count() == 0
    assert df.count() == df.select("participant", "trial", "bin").distinct().count() == 6358
    spans = df.groupBy("participant", "trial").agg((F.max("bin") - F.min("bin") + 1 - F.count("bin")).alias("d"))
    assert spans.filter("d <> 0").count() == 0


def test_choice_and_trial_facts(events, durations, rows):
    choices = rows(tr.object_choice_from_events(events, durations), "trial", "rt", "clicked_lr", "clicked")
    assert choices == [
        ("lamp", 300.0, "image-left", "ref"),
        ("mute", None, None, "none"),
        ("pin", 90.0, "image-right", "ref"),
        ("zoo", 140.0, "image-right", "dis"),
    ]
    aligned = tr.align_trials(events, durations)
    assert rows(tr.object_choice(aligned), "trial", "rt", "clicked_lr", "clicked") == choices
    info = rows(
        tr.trial_info(events, durations, client=()), "trial", "audio_played", "datapoints", "clicktime", "clicked"
    )
    assert info == [
        ("lamp", 1, 3, 300.0, "ref"),
        ("mute", 0, 1, None, "none"),
        ("pin", 1, 2, 90.0, "ref"),
        ("zoo", 1, 3, 140.0, "dis"),
    ]
    joined = tr.attach_choice(aligned, tr.object_choice(aligned).drop("fluency"), events)
    assert joined.count() == len(ALL)
    assert {r.clicked for r in joined.filter("trial = 'zoo'").collect()} == {"dis"}


def test_attention_and_side_bias(spark, rows):
    schema = "participant long, trial string, seq long, condition string, layer string, event_type string, image_right string"
    events = spark.createDataFrame(
        [
            (1, "att1", 1, "attention", "image-right", "click", "atta.png"),
            (1, "att2", 2, "attention", "image-right", "click", None),
            (1, "att3", 3, "attention", None, "click", "x.png"),
            (1, "lamp", 4, "1_1FluentL", "image-left", "click", "x.png"),
            (2, "lamp", 5, None, "image-left", "move", "x.png"),
        ],
        schema,
    )
    assert rows(tr.attention_score(events)) == [(1, 3, round(1 / 3, 9))]
    kept = tr.attach_attention(events, tr.attention_score(events))
    # a null condition is not an attention trial
    assert rows(kept, "participant", "trial", "att_check") == [
        (1, "lamp", round(1 / 3, 9)),
        (2, "lamp", None),
    ]
    assert rows(tr.side_bias(kept)) == [(1, 1.0, 0.0), (2, 0.0, 0.0)]


def test_one_exchange_carries_the_window_work(events, durations):
    plan = rs.trajectories(events, durations)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("REPARTITION_BY_COL") <= 2  # the bins, once for the rows and once for the block summary


def test_a_trial_with_several_texts_is_one_trial(spark, rows):
    log = [  # participant, trial, seq, condition, refpos, event_type, layer, elapsed, trial_start, browser
        (1, "lamp", 1, None, "L", "playbackstart", None, 1000.0, 5, "A"),
        (1, "lamp", 2, "Fluent", None, "move", None, 2100.0, 6, "B"),
        (1, "lamp", 3, "Disfluent", "R", "click", "image-left", 2500.0, 7, None),
        (2, "lamp", 4, None, None, "move", None, 10.0, 8, None),
    ]
    schema = "participant long, trial string, seq long, condition string, refpos string, event_type string, layer string, elapsed double, trial_start long, browser string"
    events = spark.createDataFrame(log, schema)
    durations = spark.createDataFrame([("Fluent", "lamp", 1000.0)], "condition string, item string, audio1_duration double")
    info = tr.trial_info(events, durations, ("browser",))
    got = rows(info, "participant", "trialstart", "audio_played", "datapoints", "clicktime", "clicked", "trial_condition", "browser")
    assert got == [(1, 5, 1, 1, 500.0, "ref", "Fluent", "A"), (2, 8, 0, 1, None, "none", None, None)]
    onsets = tr.trial_onsets(events)
    assert rows(onsets, "participant", "condition", "refpos", "audio1_start", "first_elapsed", "last_elapsed") == [
        (1, "Fluent", "L", 1000.0, 1000.0, 2500.0),
        (2, None, None, None, 10.0, 10.0),
    ]
    plan = events.transform(tr.trial_onsets)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange")[-1]
    assert "SortAggregate" not in before_shuffle and "HashAggregate" in before_shuffle

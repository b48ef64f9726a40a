"""Joins, summaries, quality rules, cohorts and models on small invented tables."""

import math

import pytest
from pyspark.sql import functions as F

from tracelane.operators import aggregate as agg
from tracelane.operators import clean as cl
from tracelane.operators import cohort as co
from tracelane.operators import model as mo
from tracelane.operators import quality as qu
from tracelane.operators import skew
from tracelane.operators.joins import membership_flag, natural_join


def test_natural_join_matches_null_keys(spark, rows):
    left = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, s string, v string")
    right = spark.createDataFrame([(1, None, 10), (2, "y", 20)], "k int, s string, n int")
    assert rows(natural_join(left, right), "v", "n") == [("a", 10), ("b", None)]
    assert rows(natural_join(left, right, null_safe=False), "v", "n") == [("a", None), ("b", None)]
    assert rows(natural_join(left, right, "right"), "k", "s", "v", "n") == [(1, None, "a", 10), (2, "y", None, 20)]
    with pytest.raises(ValueError, match="no shared columns"):
        natural_join(left.select("v"), right.select("n"))


@pytest.mark.parametrize("hot_rows", [1, 2, 1_000])
@pytest.mark.parametrize("null_safe", [True, False])
def test_salted_join_equals_plain_join(spark, rows, monkeypatch, hot_rows, null_safe):
    left = spark.range(60).selectExpr("if(id < 40, 1, if(id < 50, id, null)) AS k", "id")
    right = spark.createDataFrame([(1, "one"), (41, "x"), (None, "none")], "k long, v string")
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    got = rows(skew.salted_left_join(left, right, ["k"], ["id"], null_safe=null_safe), "id", "k", "v")
    cond = left["k"].eqNullSafe(right["k"]) if null_safe else left["k"] == right["k"]
    want = rows(left.join(right, cond, "left").select(left["id"], left["k"], "v"))
    assert got == want and len(got) == 60


def test_heavy_key_is_spread_over_sub_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    left = spark.range(1_000).selectExpr("if(id < 900, 0, id) AS k", "id")
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    joined = skew.salted_left_join(left, right, ["k"], ["id"], keep_slice=True)
    sizes = [r["count"] for r in joined.groupBy("k", "__slice").count().collect()]
    assert sum(sizes) == 1_000 and max(sizes) < 200
    assert joined.filter("v IS NULL").count() == 0


def test_membership_is_never_null(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, w string")
    known = spark.createDataFrame([("a",), ("a",)], "x string")
    assert rows(membership_flag(df, "w", known, "x", "found"), "id", "found") == [(1, True), (2, False), (3, False)]
    with_null = spark.createDataFrame([("a",), (None,)], "x string")
    assert rows(membership_flag(df, "w", with_null, "x", "found"), "id", "found")[2] == (3, True)


@pytest.mark.parametrize("size", [1, 2, 100])
def test_step_features_across_blocks(spark, rows, size):
    df = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 4.0), ("a", 9, 4.0), ("b", 1, 1.0), ("b", 2, None), ("b", 3, 2.0)],
        "k string, n long, x double",
    )
    assert rows(agg.step_features(df, ["k"], "n", "x", size), "k", "n", "step", "cumulative") == [
        ("a", 1, None, None),
        ("a", 2, 2.0, 2.0),
        ("a", 3, -3.0, 5.0),
        ("a", 9, 0.0, 5.0),
        ("b", 1, None, None),
        ("b", 2, None, None),
        ("b", 3, None, None),
    ]


def test_step_features_of_rows_far_apart(spark, rows, monkeypatch):
    df = spark.range(4_000).selectExpr("id % 3 AS k", "id * 1000003 AS n", "cast(id * id % 17 AS double) AS x").repartition(7)
    blocks = {}

    def kept(rows, order, cut=skew.range_blocks):
        blocks["all"] = cut(rows, order)
        return blocks["all"]

    monkeypatch.setattr(agg, "range_blocks", kept)
    got = rows(agg.step_features(df, ["k"], "n", "x", sparse=True))
    assert got == rows(agg.step_features(df, ["k"], "n", "x", size=10**12))
    assert blocks["all"].select("k", "__block").distinct().count() <= 3 + 4  # groups and partitions, not rows


@pytest.mark.parametrize("hot_rows", [1, 1_000])
def test_spread_natural_join(spark, rows, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    left = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, "x", "c"), (None, "x", "d")], "k int, s string, v string")
    right = spark.createDataFrame([(1, None, 10, "z"), (2, "y", 20, "z"), (None, "x", 30, "z")], "k int, s string, n int, v string")
    for null_safe in (True, False):
        plain = natural_join(left, right, keys=["k", "s"], null_safe=null_safe)
        assert rows(natural_join(left, right, keys=["k", "s"], null_safe=null_safe, spread=["v"])) == rows(plain)
    with pytest.raises(ValueError, match="left joins"):
        natural_join(left, right, "inner", ["k"], spread=["v"])


@pytest.mark.parametrize("size", [2, 100])
def test_autocorrelation_across_blocks(spark, size):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("flat", i, 1.0) for i in range(4)], "k string, n long, x double")
    got = {r.k: r.autocorr for r in agg.lag1_autocorr(df, ["k"], "n", "x", size).collect()}
    a, b = values[1:], values[:-1]
    ma, mb = sum(a) / 6, sum(b) / 6
    top = sum((p - ma) * (q - mb) for p, q in zip(a, b))
    want = top / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    assert abs(got["a"] - want) < 1e-12 and got["flat"] is None


def test_duplicates_and_series_starts(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "w string, seq long")
    marked = rows(agg.mark_duplicates(df, "w", "seq"), "seq", "duplicate")
    assert marked == [(1, False), (2, False), (3, True), (4, False), (5, True)]
    assert rows(agg.series_start(df, ["w"], "seq"), "seq", "start_event")[2] == (3, False)
    assert agg.has_duplicates(df, "w").first()[0] is True
    assert agg.has_duplicates(df.filter("seq = 2"), "w").first()[0] is False
    index = rows(agg.first_index(df, ["w"], F.col("seq") >= 2, "seq", "seq"))
    assert index == [(None, 1, 4), ("a", 2, 3), ("b", 1, 2)]


def test_timecourse_levels(spark, rows):
    df = spark.createDataFrame(
        [(1, "F", 0, 0.2, 1.0), (1, "F", 0, 0.4, 1.0), (2, "F", 0, 0.9, 1.0), (2, "F", 1, None, 1.0), (1, "F", 1, 0.5, 1.0)],
        "s int, c string, bin long, a double, b double",
    )
    out = rows(agg.timecourse(df, ["a", "b"], "s", ["c"]), "bin", "AOI", "mean_prop", "se", "time")
    sd = math.sqrt((0.3 - 0.6) ** 2 + (0.9 - 0.6) ** 2)
    assert out == [
        (0, "a", 0.6, round(sd / math.sqrt(2), 9), 0),
        (0, "b", 1.0, 0.0, 0),
        (1, "a", None, None, 20),
        (1, "b", 1.0, 0.0, 20),
    ]
    skip = rows(agg.timecourse(df, ["a"], "s", ["c"], na="skip"), "bin", "mean_prop", "se")
    assert skip[1] == (1, 0.5, None)
    flat = rows(agg.timecourse_rows(df, ["a"], ["c"]), "bin", "mean_prop", "low")
    assert flat[0][1] == 0.5


def test_contingency_tables(spark, rows):
    df = spark.createDataFrame(
        [("x", "ref")] * 8 + [("x", "dis")] * 2 + [("y", "ref")] * 3 + [("y", "dis")] * 7 + [(None, "ref")],
        "f string, c string",
    )
    assert rows(agg.freq_table(df, ["c"])) == [("dis", 9, round(9 / 21, 9)), ("ref", 12, round(12 / 21, 9))]
    by_row = rows(agg.freq_table(df, ["f", "c"], ["f"]))
    assert by_row[0] == ("x", "dis", 2, 0.2)
    table = agg.strat_table(df.filter("f IS NOT NULL"), "f", ["c"]).collect()
    # 2x2 with continuity correction: n (|ad - bc| - n/2)^2 / (row and column products)
    want = 20 * (abs(8 * 7 - 2 * 3) - 10) ** 2 / (10 * 10 * 11 * 9)
    assert {r.dof for r in table} == {1} and all(abs(r.chi_square - want) < 1e-9 for r in table)
    three = df.filter("f IS NOT NULL").withColumn("c", F.when(F.rand(1) < 2, F.concat("c", F.lit(""))))
    assert agg.strat_table(three, None, ["c"]).count() == 2


TRIALS = "participant long, trial string, trialstart long, audio_played int, datapoints long, clicktime double, clicked string, trial_condition string, att_check double, browser string, version string, os string"


def test_participant_summary_and_rules(spark):
    ms = 1_700_000_000_000
    trials = spark.createDataFrame(
        [
            (1, "a", ms, 1, 5, 300.0, "ref", "Fluent", 0.75, "B", "V", "O"),
            (1, "b", ms + 60_500, 0, 4, None, "none", "Filler", 0.75, "C", "V", "O"),
            (1, "c", 5, 1, 0, -20.0, "dis", "Disfluent", 0.75, "C", "V", "O"),
            (2, "a", ms, 1, 1, 100.0, "ref", "Fluent", None, None, "V", "O"),
        ],
        TRIALS,
    )
    ppt = {r.participant: r for r in qu.participant_info(trials).collect()}
    one = ppt[1]
    assert (one.total_trials, one.empty_trials, one.crit_trials, one.crit_nonempty_trials) == (3, 1, 2, 1)
    # no audio counts as an early click even without a click time
    assert one.n_clickprenoun_nonempty == 1 and abs(one.p_clickprenoun_nonempty - 100 / 3) < 1e-9
    assert one.avg_clicktime == 140.0 and one.browser == "B"
    # the near-zero start is not the first time; whole seconds only
    assert one.time_taken == 1.0 and one.first_time1.year == 2023
    included = [r.include_trial for r in qu.trial_inclusion(trials).orderBy("participant", "trial").collect()]
    assert included == ["valid", "invalid", "invalid", "invalid"]

    rules = qu.Thresholds(min_trials=3, min_critical=1, max_early_percent=50, min_click_ms=100)
    sided = qu.participant_info(trials).withColumn("lside_clicks", F.lit(0.5))
    out = {r.participant: r.include_ppt for r in qu.participant_inclusion(sided, rules).collect()}
    assert out == {1: "valid", 2: "invalid"}
    lenient = qu.Thresholds(min_trials=1, min_critical=1, max_early_percent=50, min_click_ms=100)
    out = {r.participant: r.include_ppt for r in qu.participant_inclusion(sided, lenient).collect()}
    assert out == {1: "valid", 2: None}  # the unknown attention score decides
    flags = {r.participant: r for r in qu.inclusion_criteria_flags(sided, rules).collect()}
    assert flags[2].criterion3_attention_check2 is None and flags[1].criterion1_total_trials55 == 1


def test_repeated_participation(spark, rows):
    ppt = spark.createDataFrame(
        [
            (1, "A", 0, "valid"),
            (2, "A", 60, "valid"),
            (3, "A", 60, None),
            (4, "B", 60, "valid"),
            (5, "B", 60, "invalid"),
            (6, "C", 60, "valid"),
            (7, None, 60, "valid"),
            (8, "D", 60, "valid"),
        ],
        "participant long, mturk_id string, total_trials long, include_ppt string",
    )
    roster = spark.createDataFrame(
        [("A", "ok", "b 1"), ("A", "fine", "b 2"), ("B", "code TWAIN", "b 1"), ("B", None, "b 2"), ("C", "ok", "b 1")],
        "mturk_id string, comments string, batch string",
    )
    out = qu.resolve_duplicates(ppt, roster)
    assert rows(out, "participant", "duplicate", "duplicate2", "dup_incl", "submitted") == [
        (1, "duplicate", "duplicate", "valid : duplicate", "submitted"),
        (2, "duplicate", "n-dup", "valid : n-dup", "submitted"),
        (3, "duplicate", "duplicate", "NA : duplicate", "submitted"),
        (4, "duplicate", "duplicate", "valid : duplicate", "submitted"),
        (5, "duplicate", "duplicate", "invalid : duplicate", "submitted"),
        (6, "n-dup", "n-dup", "valid : n-dup", "submitted"),
        (7, "unknown", "unknown", "valid : unknown", None),
        (8, "n-dup", "n-dup", "valid : n-dup", "not submitted"),
    ]
    text = roster.withColumn("seq", F.monotonically_increasing_id())
    assert rows(agg.attempts(text), "mturk_id", "position", "nr_attempts", "comments") == [
        ("A", 1, 2, "ok"),
        ("A", 2, 2, "fine"),
        ("B", 1, 2, "code TWAIN"),
        ("B", 2, 2, None),
    ]


def test_attempts_are_the_same_rows_however_a_worker_is_cut(spark, rows, monkeypatch):
    roster = spark.range(20).selectExpr("if(id < 16, 'A', 'B') AS mturk_id", "id AS seq", "concat('b', id) AS batch", "'c' AS comments")
    whole = rows(agg.attempts(roster, batch_prefix="b"))
    assert whole[3] == ("A", 4, 16, "3", "c") and len(whole) == 20
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    assert rows(agg.attempts(roster, batch_prefix="b")) == whole
    assert len(rows(agg.listed_attempts(roster))) == 20


def test_first_answer_counts_and_nobody_is_lost(spark, rows):
    ppt = spark.createDataFrame([(1,), (2,)], "participant long")
    questions = spark.createDataFrame(
        [(1, "your language", "Perhaps", 2), (1, "your language", "No - Only English", 1), (3, "your language", "Yes", 3)],
        "participant long, question string, answer string, seq long",
    )
    out = qu.attach_questionnaire(ppt, questions)
    assert rows(out, "participant", "bilingual", "bilingual2") == [
        (1, "No - Only English", "Monolingual"),
        (2, None, None),
    ]


def test_cohort_union_and_exclusion(spark, rows):
    online = spark.createDataFrame([(87, 60, "w"), (88, 60, "w")], "participant long, total_trials long, extra string")
    lab = spark.createDataFrame([(1, 55), (2, 56)], "participant long, total_trials long")
    merged = co.merge_cohorts(Mturk=online, LAB=lab)
    assert rows(merged, "cohort", "participant", "extra") == [("LAB", 2, None), ("Mturk", 88, "w")]
    tagged = cl.split_cohort(cl.tag_cohort(lab, "LAB"))
    assert rows(tagged, "cohort", "participant") == [("LAB", "1"), ("LAB", "2")]


def test_cleaning(spark, rows):
    files = [("e_anchor_f1.wav", 1.5), ("e_bread_d1.wav", 2.0), ("f_leaf_1.wav", 1.0), ("e_anchor_f2.wav", 9.0), ("p1.wav", 1.0)]
    df = spark.createDataFrame(files, "file string, duration double")
    assert rows(cl.parse_durations(df), "condition", "item", "audio1_duration") == [
        ("Disfluent", "bread", 2000.0),
        ("Filler", "leaf", 1000.0),
        ("Fluent", "anchor", 1500.0),
    ]
    assert abs(cl.outer_edge() - 433.4) < 1e-9
    xs = spark.createDataFrame([(500.0,), (-100.0,), (None,)], "x double")
    assert [r.outside for r in cl.flag_outside(xs).collect()] == [1, 0, None]
    shifted = spark.createDataFrame([("B", None), ("B", "img")], "browser string, image_left string")
    assert [r.image_left for r in cl.coalesce_shifted(shifted, {"image_left": "browser"}).collect()] == ["B", "img"]


def test_enrichment_modes(spark, rows):
    ppt = spark.createDataFrame([(1, "B", "valid")], "participant long, browser string, include_ppt string")
    trials = spark.createDataFrame([(1, "a", "B", 9), (1, "b", "C", 8)], "participant long, trial string, browser string, n int")
    bins = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], "participant long, trial string, bin long")
    assert rows(qu.enrich(bins, ppt, trials), "trial", "n", "include_ppt") == [("a", 9, "valid"), ("b", 8, "valid")]
    assert rows(qu.enrich(bins, ppt, trials, "natural"), "trial", "n") == [("a", 9), ("b", None)]


def test_model_frame_and_estimates(spark, rows):
    data = [
        (s, "t", c, "LAB", b, b * 1000, 0.1 * b, 0.0, "valid", "valid", "n-dup", "No")
        for s in (1, 2)
        for c in ("Fluent", "Disfluent")
        for b in range(4)
    ]
    schema = (
        "participant long, trial string, condition string, cohort string, bin long, time long, refprop double, "
        "disprop double, include_ppt string, include_trial string, duplicate2 string, bilingual string"
    )
    frame = mo.model_frame(spark.createDataFrame(data, schema)).cache()
    # moments from all four times, rows of the first three kept
    times = [0, 1, 2, 3] * 4
    sd = math.sqrt(sum((t - 1.5) ** 2 for t in times) / 15)
    assert frame.count() == 12
    assert {round(r.time_z, 9) for r in frame.collect()} == {round((t - 1.5) / sd, 9) for t in (0, 1, 2)}
    assert {r.fluency_c for r in frame.collect()} == {-0.5, 0.5}
    slopes = mo.subject_slopes(frame, "elog_bias", "time_z", ["fluency"])
    assert slopes.count() == 4
    fitted = mo.fitted_timecourse(frame, slopes, ["fluency"])
    observed = rows(fitted.filter("AOI = 'elog_bias'"), "fluency", "bin", "mean_prop")
    direct = rows(agg.timecourse(frame, ["elog_bias"], "sub", ["fluency"]), "fluency", "bin", "mean_prop")
    assert observed == direct


def test_choice_logit_agrees_with_spark_ml(spark):
    clicks = spark.createDataFrame(
        [("Fluent", "ref")] * 30 + [("Fluent", "dis")] * 10 + [("Disfluent", "ref")] * 15 + [("Disfluent", "dis")] * 25,
        "fluency string, clicked string",
    )
    row = mo.choice_logit(clicks).first()
    fit = mo.choice_glm(cl.contrast_code(clicks, "fluency", mo.FLUENCY_CODES), ["fluency_c"])
    assert abs(row.slope - fit.coefficients[0]) < 1e-5
    assert abs(row.intercept - fit.intercept) < 1e-5
    assert abs(row.se_slope - fit.summary.coefficientStandardErrors[0]) < 1e-5

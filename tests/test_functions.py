from pyspark.sql import functions as F

from tracelane import functions as fn


def one(spark, expr, schema="x double", values=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(expr.alias("v")).collect()]


def test_halves_round_to_even_without_negative_zero(spark):
    values = [(-10.0,), (10.0,), (30.0,), (50.0,), (-6.0,), (None,)]
    assert one(spark, fn.to_bin("x", 20), values=values) == [0, 0, 2, 2, 0, None]
    assert one(spark, fn.mround("x", 20), values=values) == [0, 0, 40, 40, 0, None]


def test_unknown_condition_gives_null(spark):
    values = [(1.0,), (-1.0,), (None,)]
    assert one(spark, fn.if_else(F.col("x") > 0, F.lit("a"), F.lit("b")), values=values) == ["a", "b", None]


def test_negated_match_keeps_null(spark):
    df = spark.createDataFrame([("left",), ("other",), (None,)], "s string")
    kept = df.filter(~fn.matches("s", "left")).collect()
    assert sorted(str(r.s) for r in kept) == ["None", "other"]


def test_strict_aggregates_spread_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 1.0), (2, 3.0)], "k int, x double")
    out = df.groupBy("k").agg(
        fn.strict_avg("x").alias("a"),
        fn.strict_sum("x").alias("s"),
        fn.strict_min("x").alias("lo"),
        fn.strict_max("x").alias("hi"),
        F.avg("x").alias("known"),
    )
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {
        1: (None, None, None, None, 1.0),
        2: (2.0, 4.0, 1.0, 3.0, 2.0),
    }


def test_number_text_has_fifteen_digits(spark):
    values = [(5.0,), (0.75,), (1 / 3,), (100 / 3,), (None,)]
    assert one(spark, fn.number_text("x"), values=values) == [
        "5",
        "0.75",
        "0.333333333333333",
        "33.3333333333333",
        "NA",
    ]


def test_last_keeps_a_null_value_and_first_of_none_is_null(spark):
    df = spark.createDataFrame(
        [(1, 1, "click", "image-left"), (1, 2, "click", None), (2, 1, "move", "image-left")],
        "p int, seq long, event_type string, layer string",
    )
    click = F.col("event_type") == "click"
    out = df.groupBy("p").agg(
        fn.last_where("layer", click, "seq").alias("last"),
        fn.first_where("layer", click, "seq").alias("first"),
        fn.any_equal("event_type", "move").alias("moved"),
        fn.share_where(click).alias("share"),
        fn.distinct_where("layer", click).alias("n"),
    )
    assert {r.p: tuple(r)[1:] for r in out.collect()} == {
        1: (None, "image-left", 0, 1.0, 1),
        2: (None, None, 1, 0.0, 0),
    }


def test_ordered_text_spells_null(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "seq int, v string")
    row = df.agg(
        fn.ordered_concat("v", "seq").alias("t"), fn.ordered_list("v", "seq").alias("l")
    ).first()
    assert row.t == "a, b, NA" and row.l == ["a", "b", None]


def test_condition_code_parts(spark):
    df = spark.createDataFrame([("1_3FluentL",), ("4_12DisfluentR",), ("2_1FillerL",)], "c string")
    out = df.select(fn.condition_name("c"), fn.condition_side("c")).collect()
    assert [tuple(r) for r in out] == [("Fluent", "L"), ("Disfluent", "R"), ("Filler", "L")]


def test_click_outcomes(spark):
    df = spark.createDataFrame(
        [("image-left", "L"), ("image-right", "L"), (None, "L"), ("background", "R"), ("image-right", "R")],
        "layer string, refpos string",
    )
    out = df.select(fn.object_chosen(fn.click_side("layer"), "refpos")).collect()
    assert [r[0] for r in out] == ["ref", "dis", "none", "none", "ref"]


def test_recode_keeps_unmapped_levels_and_null(spark):
    df = spark.createDataFrame([("No",), ("Perhaps",), (None,)], "c string")
    assert [r[0] for r in df.select(fn.recode("c", {"No": "Monolingual"})).collect()] == [
        "Monolingual",
        "Perhaps",
        None,
    ]


def test_both_forms_of_the_empirical_logit(spark):
    import math

    for mode, want in {
        "as_written": math.log(0.25 + 0.5 / (1 - 0.25 + 0.5)),
        "standard": math.log((0.25 + 0.5) / (1 - 0.25 + 0.5)),
    }.items():
        assert abs(one(spark, fn.elog("x", 1, mode), values=[(0.25,)])[0] - want) < 1e-12


def test_move_category_and_its_code(spark):
    df = spark.createDataFrame([(0.6, 0.4), (0.1, 0.9), (0.0, 0.0), (None, 0.2)], "r double, d double")
    move = fn.move_category("r", "d")
    out = df.select(move, fn.level_code(move, ["dist", "neither", "ref"])).collect()
    assert [tuple(r) for r in out] == [("ref", 3), ("dist", 1), ("neither", 2), (None, None)]


def test_epoch_and_minutes(spark):
    df = spark.createDataFrame([(1_700_000_000_999, 1_700_000_090_000)], "a long, b long")
    start, end = fn.epoch_ms_to_ts("a"), fn.epoch_ms_to_ts("b")
    row = df.select(start.alias("a"), fn.minutes_between(start, end).alias("m")).first()
    assert row.a.microsecond == 0 and row.m == 1.5

"""The shared benchmark tables read as a cursor-tracking experiment.

``events`` becomes the event log (a week of one user is a trial), ``region`` the audio durations,
``customer`` the questionnaire and ``orders`` the roster of submissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.operators.quality import (
    Thresholds,
    attach_questionnaire,
    attach_side_bias,
    attach_worker,
    participant_inclusion,
    participant_info,
)
from tracelane.operators.resample import grid_spans, steady_runs, trajectories
from tracelane.operators.trials import attention_score, side_bias, trial_info

# fixed values of the mapping
EPOCH_DAY = "2024-01-01"
WEEK_MS = 604_800_000
BIN_MS = 3_600_000
FIRST_WEEK_MS = 1_704_067_200_000
CONDITIONS = ["Fluent", "Disfluent", "Filler"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: positions already centred, condition already split (``code`` has the raw form)."""
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit(EPOCH_DAY).cast("date")) / F.lit(7)).cast("long")
    based = raw.withColumns({"k": k, "wk": week})
    mouse = F.col("event_type") != "view"
    start = F.lit(FIRST_WEEK_MS) + F.col("wk") * F.lit(WEEK_MS)
    who = F.col("user_id") + F.col("wk")
    name = F.when(who % 3 == 0, "Fluent").when(who % 3 == 1, "Disfluent").otherwise("Filler")
    side = F.when(who % 2 == 0, "L").otherwise("R")
    code = F.concat(
        F.col("wk").cast("string"), F.lit("_"), F.col("user_id").cast("string"), name, side
    )
    kind = F.when(~mouse, "playbackstart").when(F.col("event_type") == "click", "click").otherwise("move")
    layer = F.when(F.col("k") % 5 == 0, "background").when(F.col("k") % 5 <= 2, "image-left")
    return based.select(
        F.col("user_id").alias("participant"),
        F.concat(F.lit("w"), F.col("wk").cast("string")).alias("trial"),
        F.col("event_id").alias("seq"),
        "wk",
        "k",
        code.alias("code"),
        name.alias("condition"),
        side.alias("refpos"),
        F.when(mouse, "mouse").otherwise("audio").alias("event_category"),
        kind.alias("event_type"),
        layer.otherwise("image-right").alias("layer"),
        F.when(mouse, (F.round(F.col("value") * 100).cast("long") - 2000).cast("double")).alias("x"),
        F.when(mouse, (F.col("k") * 7).cast("double")).alias("y"),
        (F.unix_millis(F.col("ts").cast("timestamp")) - start).cast("double").alias("elapsed"),
        start.alias("trial_start"),
    )


def with_client_columns(events: DataFrame) -> DataFrame:
    """Client and stimulus columns with the gaps that a shifted export leaves."""
    k = F.col("k").cast("string")

    def gappy(prefix: str):
        return F.when(F.col("k") % 3 != 0, F.concat(F.lit(prefix), k))

    client = (F.col("k") % 4).cast("string")
    return events.withColumns(
        {
            "browser": F.concat(F.lit("B"), client),
            "version": F.concat(F.lit("V"), client),
            "os": F.concat(F.lit("O"), client),
            "image_left": gappy("img"),
            "image_right": gappy("pic"),
            "audio": gappy("snd"),
        }
    )


def with_attention_trials(events: DataFrame) -> DataFrame:
    """Every fourth trial as an attention check, the animal on the right in even weeks."""
    attention = (F.col("participant") + F.col("wk")) % 4 == 3
    return events.withColumns(
        {
            "condition": F.when(attention, "attention").otherwise(F.col("condition")),
            "image_right": F.when(F.col("wk") % 2 == 0, "atta.png").otherwise("other.png"),
        }
    )


def model_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration per condition and item."""
    region = table(spark, sf_dir, "region")
    return region.select(
        ((F.col("r_regionkey") + 1) * 1_800_000).cast("double").alias("audio1_duration"),
        F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("item"),
        F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"),
    )


def model_questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers per customer: a language answer and a worker id (several customers share one)."""
    customer = table(spark, sf_dir, "customer")
    seq = F.col("c_custkey") * 2
    rows = F.array(
        F.struct(
            F.lit("language spoken").alias("question"),
            F.col("c_mktsegment").alias("answer"),
            seq.alias("seq"),
        ),
        F.struct(
            F.lit("MTurk id").alias("question"),
            F.concat(F.lit("W"), (F.floor(F.col("c_custkey") / 3) * 7).cast("string")).alias("answer"),
            (seq + 1).alias("seq"),
        ),
    )
    return customer.select(F.col("c_custkey").alias("participant"), F.inline(rows))


def model_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per order; workers submit anything from once to several times."""
    orders = table(spark, sf_dir, "orders")
    worker = F.col("o_custkey") * 10 + F.month("o_orderdate") % 10
    return orders.select(
        F.concat(F.lit("W"), worker.cast("string")).alias("mturk_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("batch "), F.col("o_orderstatus")).alias("batch"),
        F.concat_ws(" ", "o_orderpriority", (F.col("o_orderkey") % 16).cast("string")).alias("comments"),
    )


# settings that give every outcome on this data (the study's own would mark everyone invalid)
EARLY_CODES = "URGENT [37]"
LANGUAGE_GROUPS = {"BUILDING": "Monolingual", "FURNITURE": "Monolingual", "MACHINERY": "Bilingual"}
THRESHOLDS = Thresholds(
    min_trials=5, min_critical=3, min_attention=0.5, max_early_percent=60, min_left=0.1, max_left=0.9
)


def model_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_score(with_attention_trials(model_events(spark, sf_dir)))


def model_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial facts with the participant's attention score."""
    events = with_client_columns(model_events(spark, sf_dir))
    trials = trial_info(events, model_durations(spark, sf_dir))
    score = model_attention(spark, sf_dir).select("participant", "att_check")
    return trials.join(score, "participant", "left")


def model_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with attention score, side bias, language group, worker id and inclusion."""
    ppt = participant_info(model_trials(spark, sf_dir))
    ppt = attach_side_bias(ppt, side_bias(model_events(spark, sf_dir)))
    questions = model_questionnaire(spark, sf_dir)
    ppt = attach_questionnaire(ppt, questions, LANGUAGE_GROUPS)
    return participant_inclusion(attach_worker(ppt, questions), THRESHOLDS)


def model_trajectories(spark: SparkSession, sf_dir: str, fill_scope: str = "trial") -> DataFrame:
    return trajectories(
        model_events(spark, sf_dir), model_durations(spark, sf_dir), BIN_MS, fill_scope
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectories as stretches of bins with steady totals."""
    return steady_runs(model_events(spark, sf_dir), model_durations(spark, sf_dir), BIN_MS)


def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last bin of every trial's grid."""
    return grid_spans(model_events(spark, sf_dir), model_durations(spark, sf_dir), BIN_MS)

"""Queries for row-level work: cleaning, filters, reshaping, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelane.functions import (
    condition_name,
    condition_side,
    epoch_ms_to_ts,
    if_else,
    matches,
    minutes_between,
    mround,
    na_text,
)
from tracelane.operators import clean as cl
from tracelane.operators.aggregate import to_long
from tracelane.operators.cohort import union_cohorts
from tracelane.operators.resample import gap_fill
from tracelane.operators.trials import align_trials
from tracelane.plans.catalogue import query
from tracelane.plans.driver_tables import (
    BIN_MS,
    model_durations,
    model_events,
    model_questionnaire,
    model_trajectories,
    table,
    with_client_columns,
)
from tracelane.plans.oracle_views import r6, statement
from tracelane.plans.queries_trials import two_cohorts

TRIAL = ["participant", "trial"]
PARTS = """parts AS (SELECT p_partkey, p_retailprice, replace(p_name, ' ', '') || p_partkey AS item,
    CASE p_partkey % 4 WHEN 0 THEN 'e_' || replace(p_name, ' ', '') || p_partkey || '_f1.wav'
    WHEN 1 THEN 'e_' || replace(p_name, ' ', '') || p_partkey || '_d1.wav'
    WHEN 2 THEN 'f_' || replace(p_name, ' ', '') || p_partkey || '_1.wav' ELSE 'p1.wav' END AS file FROM part)"""


def part_recordings(spark, sf):
    """File names and durations as the audio table has them, made from the part table."""
    item = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 4
    file = (
        F.when(kind == 0, F.concat(F.lit("e_"), item, F.lit("_f1.wav")))
        .when(kind == 1, F.concat(F.lit("e_"), item, F.lit("_d1.wav")))
        .when(kind == 2, F.concat(F.lit("f_"), item, F.lit("_1.wav")))
        .otherwise("p1.wav")
    )
    return table(spark, sf, "part").select(file.alias("file"), F.col("p_retailprice").alias("duration"))


@query(
    "p2_recentre",
    statement("SELECT participant, seq, x - 512 AS x, y - 350 AS y FROM ev", "ev"),
)
def p2(spark, sf):
    return cl.recentre(model_events(spark, sf).select("participant", "seq", "x", "y"))


@query("p3_parse_condition", statement("SELECT participant, seq, condition, refpos FROM ev", "ev"))
def p3(spark, sf):
    rows = model_events(spark, sf).select("participant", "seq", F.col("code").alias("condition"))
    return cl.parse_condition(rows).select("participant", "seq", "condition", "refpos")


@query(
    "p4_parse_durations",
    f"""WITH {PARTS} SELECT {r6('p_retailprice * 1000')} AS audio1_duration, item, CASE p_partkey % 4 WHEN 0 THEN 'Fluent'
    WHEN 1 THEN 'Disfluent' ELSE 'Filler' END AS condition FROM parts WHERE p_partkey % 4 <> 3""",
)
def p4(spark, sf):
    return cl.parse_durations(part_recordings(spark, sf))


@query(
    "p5_flag_outside",
    statement(
        """SELECT participant, seq, CASE WHEN abs(x) > 433.4 THEN 1 WHEN abs(x) <= 433.4 THEN 0 END AS outside
        FROM ev""",
        "ev",
    ),
)
def p5(spark, sf):
    return cl.flag_outside(model_events(spark, sf).select("participant", "seq", "x")).drop("x")


@query("p6_onset_clock", statement("SELECT participant, trial, seq, time FROM al", "al"))
def p6(spark, sf):
    events = model_events(spark, sf).select(*TRIAL, "seq", "condition", "event_type", "elapsed")
    return align_trials(events, model_durations(spark, sf)).select(*TRIAL, "seq", "time")


@query(
    "p7_rename_select_drop",
    "SELECT c_custkey AS participant, c_mktsegment AS bilingual FROM customer",
)
def p7(spark, sf):
    rows = table(spark, sf, "customer").drop("c_name", "c_nationkey", "c_acctbal")
    return rows.withColumnsRenamed({"c_custkey": "participant", "c_mktsegment": "bilingual"})


@query(
    "p8_tag_cohort",
    statement(
        """SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk_' ELSE 'LAB_' END || participant AS participant, seq
        FROM ev""",
        "ev",
    ),
)
def p8(spark, sf):
    parts = two_cohorts(model_events(spark, sf).select("participant", "seq"))
    tagged = [cl.tag_cohort(df, name) for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1])


@query(
    "p9_map_columns",
    statement(
        f"""SELECT participant, trial, bin, {', '.join(f'coalesce({r6(c)}, -1) AS {c}' for c in
        ['distance_travelled', 'cumulative_distance', 'ldist', 'rdist', 'ref_dist', 'dis_dist', 'ref_cdist',
         'dis_cdist'])}, {r6('refprop')} AS refprop FROM mv""",
        "mv",
    ),
)
def p9(spark, sf):
    rows = cl.map_columns(model_trajectories(spark, sf), "dist", lambda c: F.coalesce(c, F.lit(-1.0)))
    return rows.select(*TRIAL, "bin", *[c for c in rows.columns if "dist" in c], "refprop")


@query(
    "p11_contrast_code",
    statement(
        """SELECT participant, seq, CASE condition WHEN 'Fluent' THEN -0.5::DOUBLE WHEN 'Disfluent' THEN 0.5::DOUBLE END
        AS condition_c FROM ev""",
        "ev",
    ),
)
def p11(spark, sf):
    rows = model_events(spark, sf).select("participant", "seq", "condition")
    return cl.contrast_code(rows, "condition", {"Fluent": -0.5, "Disfluent": 0.5}).drop("condition")


@query(
    "p11_treatment_code",
    statement(
        """SELECT participant, seq, CASE condition WHEN 'Fluent' THEN 1 WHEN 'Disfluent' THEN 2 WHEN 'Filler' THEN 3 END
        AS condition_code, CASE WHEN condition = 'Disfluent' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "condition_Disfluent",
        CASE WHEN condition = 'Filler' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "condition_Filler" FROM ev""",
        "ev",
    ),
)
def p11_treatment(spark, sf):
    rows = model_events(spark, sf).select("participant", "seq", "condition")
    return cl.treatment_code(rows, "condition", ["Fluent", "Disfluent", "Filler"]).drop("condition")


@query("f1_deny_list", statement("SELECT participant, trial, seq FROM ev WHERE participant <> 7", "ev"))
def f1(spark, sf):
    return model_events(spark, sf).filter(F.col("participant") != 7).select(*TRIAL, "seq")


@query(
    "f2_regex_keep_and_drop",
    statement(
        """SELECT participant, seq, layer, image_left FROM client WHERE regexp_matches(layer, 'left|right')
        AND NOT coalesce(regexp_matches(image_left, 'img1'), false)""",
        "client",
    ),
)
def f2(spark, sf):
    rows = with_client_columns(model_events(spark, sf)).select("participant", "seq", "layer", "image_left")
    return rows.filter(matches("layer", "left|right") & ~matches("image_left", "img1"))


@query(
    "f3_range_filter",
    statement("SELECT participant, trial, bin FROM binned WHERE time <= 360000000 AND x >= 0", "binned"),
)
def f3(spark, sf):
    rows = model_trajectories(spark, sf).filter((F.col("time") <= 360_000_000) & (F.col("x") >= 0))
    return rows.select(*TRIAL, "bin")


@query("f4_null_filter", statement("SELECT participant, seq, x FROM ev WHERE x IS NOT NULL", "ev"))
def f4(spark, sf):
    return model_events(spark, sf).filter(F.col("x").isNotNull()).select("participant", "seq", "x")


@query(
    "f8_filler_removal",
    statement("SELECT participant, trial, seq, condition FROM ev WHERE condition <> 'Filler'", "ev"),
)
def f8(spark, sf):
    rows = model_events(spark, sf).filter(F.col("condition") != "Filler")
    return rows.select(*TRIAL, "seq", "condition")


@query(
    "j4_gap_fill_join_free",
    statement(
        f"""SELECT participant, trial, bin, {r6('x')} AS x FROM (
        SELECT g.participant, g.trial, g.bin, last_value(o.x IGNORE NULLS) OVER (PARTITION BY g.participant, g.trial
          ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
        FROM (SELECT participant, trial, unnest(range(min(bin), max(bin) + 1)) AS bin FROM xy GROUP BY participant, trial) g
        LEFT JOIN xy o ON o.participant = g.participant AND o.trial = g.trial AND o.bin = g.bin)""",
        "xy",
    ),
)
def j4(spark, sf):
    from tracelane.functions import to_bin
    from tracelane.operators.resample import bin_mean

    aligned = align_trials(model_events(spark, sf), model_durations(spark, sf)).filter(F.col("time").isNotNull())
    sparse = bin_mean(aligned, TRIAL, to_bin("time", BIN_MS), ["x"], F.col("event_category") == "mouse")
    return gap_fill(sparse, TRIAL, ["x"])


W1 = statement(
    f"SELECT participant, trial, bin, {r6('x')} AS x, {r6('y')} AS y FROM binned", "binned"
)


@query("w1_carry_forward", W1)
def w1(spark, sf):
    return model_trajectories(spark, sf).select(*TRIAL, "bin", "x", "y")


@query(
    "r1_wide_to_long",
    statement(
        " UNION ALL ".join(
            f"""SELECT participant, trial, bin, '{m}' AS "AOI", {r6(m)} AS prop FROM mv"""
            for m in ("refprop", "disprop")
        ),
        "mv",
    ),
)
def r1(spark, sf):
    rows = model_trajectories(spark, sf).select(*TRIAL, "bin", "refprop", "disprop")
    return to_long(rows, [*TRIAL, "bin"], ["refprop", "disprop"])


@query(
    "r2_explode_parallel_lists",
    """SELECT o_orderkey, o_custkey AS id, o_orderstatus AS label FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey, o_orderpriority FROM orders""",
)
def r2(spark, sf):
    """Two lists per order, expanded side by side."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array("o_custkey", "o_orderkey").alias("id"),
        F.array("o_orderstatus", "o_orderpriority").alias("label"),
    )
    return orders.select("o_orderkey", F.inline(F.arrays_zip("id", "label")))


@query(
    "r3_sequence_per_group",
    statement(
        """SELECT participant, unnest(range(min(wk), max(wk) + 1)) AS wk FROM ev GROUP BY participant""", "ev"
    ),
)
def r3(spark, sf):
    span = model_events(spark, sf).groupBy("participant").agg(F.min("wk").alias("a"), F.max("wk").alias("b"))
    return span.select("participant", F.explode(F.sequence("a", "b")).alias("wk"))


@query(
    "r4_split_column",
    statement(
        """SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort,
        CAST(participant AS VARCHAR) AS participant, seq FROM ev""",
        "ev",
    ),
)
def r4(spark, sf):
    return cl.split_cohort(p8(spark, sf)).select("cohort", "participant", "seq")


@query(
    "o1_multi_key_sort",
    statement("SELECT participant, trial, seq, event_type FROM ev ORDER BY participant, trial DESC, seq", "ev"),
)
def o1(spark, sf):
    return model_events(spark, sf).select(*TRIAL, "seq", "event_type").orderBy(
        "participant", F.desc("trial"), "seq"
    )


@query("o2_head", statement("SELECT participant, trial, seq FROM ev ORDER BY seq DESC LIMIT 6", "ev"))
def o2(spark, sf):
    return model_events(spark, sf).select(*TRIAL, "seq").orderBy(F.desc("seq")).limit(6)


@query(
    "u1_union_by_name",
    statement(
        """SELECT 'Mturk' AS cohort, participant, seq, layer, CAST(NULL AS DOUBLE) AS y FROM ev WHERE participant % 2 = 0
        UNION ALL BY NAME SELECT 'LAB' AS cohort, participant, seq, CAST(NULL AS VARCHAR) AS layer, y FROM ev
        WHERE participant % 2 = 1""",
        "ev",
    ),
)
def u1(spark, sf):
    parts = two_cohorts(model_events(spark, sf))
    return union_cohorts(
        Mturk=parts["Mturk"].select("participant", "seq", "layer"), LAB=parts["LAB"].select("y", "seq", "participant")
    )


@query(
    "u2_positional_bind",
    "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def u2(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return customers.union(table(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("u3_distinct_rows", statement("SELECT participant, trial, condition, refpos FROM tc", "tc"))
def u3(spark, sf):
    return model_events(spark, sf).select(*TRIAL, "condition", "refpos").distinct()


@query(
    "x1_round_to_multiple",
    statement(
        "SELECT participant, seq, CAST(round_even(x / 20.0, 0) AS BIGINT) * 20 AS x20 FROM ev", "ev"
    ),
)
def x1(spark, sf):
    return model_events(spark, sf).select("participant", "seq", mround("x", 20).alias("x20"))


@query(
    "x2_arithmetic",
    statement(
        f"""SELECT participant, seq, abs(x) AS ax, {r6('ln(k + 1)')} AS lk, {r6('sqrt(k)')} AS rk FROM ev""", "ev"
    ),
)
def x2(spark, sf):
    return model_events(spark, sf).select(
        "participant", "seq", F.abs("x").alias("ax"), F.log(F.col("k") + 1).alias("lk"), F.sqrt("k").alias("rk")
    )


@query(
    "x3_substring_length",
    "SELECT c_custkey, substr(c_name, 3) AS tail, CAST(length(c_name) AS INTEGER) AS size FROM customer",
)
def x3(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", F.substring(name, F.lit(3), F.length(name)).alias("tail"), F.length(name).alias("size")
    )


@query(
    "x4_regex_functions",
    statement(
        """SELECT seq, regexp_matches(code, 'Fluent|Filler') AS named, regexp_replace(code, '[0-9_]', '', 'g') AS bare
        FROM ev""",
        "ev",
    ),
)
def x4(spark, sf):
    return model_events(spark, sf).select(
        "seq",
        matches("code", "Fluent|Filler").alias("named"),
        F.regexp_replace("code", "[0-9_]", "").alias("bare"),
    )


@query(
    "x5_paste",
    statement(
        "SELECT seq, participant || '<br>' || coalesce(CAST(image_left AS VARCHAR), 'NA') AS label FROM client", "client"
    ),
)
def x5(spark, sf):
    rows = with_client_columns(model_events(spark, sf))
    return rows.select("seq", F.concat_ws("<br>", na_text("participant"), na_text("image_left")).alias("label"))


@query(
    "x6_nested_choice",
    statement(
        """SELECT seq, CASE WHEN x > 0 THEN 'right' WHEN x < -1000 THEN 'far left' WHEN x <= 0 THEN 'left' END AS place
        FROM ev""",
        "ev",
    ),
)
def x6(spark, sf):
    x = F.col("x")
    place = if_else(x > 0, F.lit("right"), if_else(x < -1000, F.lit("far left"), F.lit("left")))
    return model_events(spark, sf).select("seq", place.alias("place"))


@query(
    "x7_missing_and_membership",
    statement("SELECT seq, x IS NULL AS no_x, k IN (1, 2, 3) AS small_k FROM ev", "ev"),
)
def x7(spark, sf):
    return model_events(spark, sf).select(
        "seq", F.col("x").isNull().alias("no_x"), F.col("k").isin(1, 2, 3).alias("small_k")
    )


@query(
    "x8_casts",
    statement(
        """SELECT seq, TRY_CAST(split_part(code, '_', 1) AS BIGINT) AS wk, TRY_CAST(layer AS DOUBLE) AS not_a_number
        FROM ev""",
        "ev",
    ),
)
def x8(spark, sf):
    return model_events(spark, sf).select(
        "seq",
        F.split("code", "_")[0].try_cast("long").alias("wk"),
        F.col("layer").try_cast("double").alias("not_a_number"),
    )


@query(
    "x9_times",
    statement(
        f"""SELECT seq, strftime(t, '%Y-%m-%d %H:%M:%S') AS at, CAST(hour(t) AS INTEGER) AS hour,
        {r6('(epoch(t) - trial_start / 1000.0) / 60.0')} AS minutes FROM (SELECT *,
        make_timestamp(CAST(floor((trial_start + elapsed) / 1000.0) AS BIGINT) * 1000000) AS t FROM ev)""",
        "ev",
    ),
)
def x9(spark, sf):
    at = epoch_ms_to_ts(F.col("trial_start") + F.col("elapsed"))
    minutes = minutes_between(epoch_ms_to_ts("trial_start"), at)
    return model_events(spark, sf).select(
        "seq",
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.hour(at).alias("hour"),
        minutes.alias("minutes"),
    )


@query(
    "x3_condition_parts",
    statement("SELECT seq, condition AS name, refpos AS side FROM ev", "ev"),
)
def x3_condition(spark, sf):
    return model_events(spark, sf).select(
        "seq", condition_name("code").alias("name"), condition_side("code").alias("side")
    )


@query("s2_questionnaire_rows", statement("SELECT participant, question, answer, seq FROM qs", "qs"))
def s2_rows(spark, sf):
    return model_questionnaire(spark, sf)

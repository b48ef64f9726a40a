"""Queries for list construction and for files written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tracelane import sources as so
from tracelane.operators import design as de
from tracelane.operators.cohort import union_cohorts
from tracelane.operators.skew import ensure_checkpoint_dir, numbered, spread
from tracelane.plans.catalogue import query
from tracelane.plans.driver_tables import (
    model_events,
    model_questionnaire,
    model_roster,
    model_trajectories,
    table,
    with_client_columns,
)
from tracelane.plans.oracle_views import r6, statement
from tracelane.plans.queries_rows import PARTS, part_recordings
from tracelane.plans.queries_trials import two_cohorts

SEED = 20
REPLICAS = 2
CRITICAL, FILLER, POOL = 20, 40, 60  # items of a list, and distractors of a pool

# the items of a design: critical items from the parts, fillers from the suppliers
ITEMS = "items AS (SELECT 'part' || p_partkey AS item, p_partkey AS item_no FROM part)"
SQUARE = """square AS (SELECT item AS trial, c.condition,
    CAST((c.no + item_no // 5) % 4 + 1 AS INTEGER) AS "group" FROM items CROSS JOIN
    (VALUES (0, 'FluentL'), (1, 'FluentR'), (2, 'DisfluentL'), (3, 'DisfluentR')) c(no, condition))"""
FILLERS = """fillers AS (SELECT 'supp' || s_suppkey AS trial, c.condition,
    CAST((c.no + s_suppkey // 10) % 4 + 1 AS INTEGER) AS "group" FROM supplier CROSS JOIN
    (VALUES (0, 'FillerL'), (1, 'FillerL'), (2, 'FillerR'), (3, 'FillerR')) c(no, condition))"""
EVERYTHING = f"""{ITEMS}, {SQUARE}, {FILLERS},
everything AS (SELECT * FROM square UNION ALL SELECT * FROM fillers)"""
# sets of 20 critical items, each with one of the sets of 40 fillers
SETS = f"""cnum AS (SELECT 'part' || p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS no FROM part),
fnum AS (SELECT 'supp' || s_suppkey AS item, row_number() OVER (ORDER BY s_suppkey) - 1 AS no FROM supplier),
sets AS (SELECT no // {CRITICAL} AS item_set, item AS trial, c.condition,
    CAST((c.no2 + no % {CRITICAL} // 5) % 4 + 1 AS INTEGER) AS "group" FROM cnum CROSS JOIN
    (VALUES (0, 'FluentL'), (1, 'FluentR'), (2, 'DisfluentL'), (3, 'DisfluentR')) c(no2, condition)
    UNION ALL SELECT s.item_set, f.item, c.condition,
    CAST((c.no2 + f.no % {FILLER} // 10) % 4 + 1 AS INTEGER) FROM (SELECT DISTINCT no // {CRITICAL} AS item_set FROM cnum) s
    JOIN fnum f ON f.no // {FILLER} = s.item_set % (SELECT max(no) // {FILLER} + 1 FROM fnum) CROSS JOIN
    (VALUES (0, 'FillerL'), (1, 'FillerL'), (2, 'FillerR'), (3, 'FillerR')) c(no2, condition))"""
LISTS = f"""{SETS},
lists AS (SELECT trial, item_set || '_' || "group" || '_' || j AS list,
    item_set || '_' || "group" || '_' || j || condition AS condition
    FROM sets CROSS JOIN (SELECT unnest(range(1, {REPLICAS + 1})) AS j))"""
LAYERED = f"""{LISTS},
layered AS (SELECT trial, list, condition, layer, CASE
    WHEN layer = 'audio' AND condition LIKE '%Filler%' THEN 'f_' || trial || '_.wav'
    WHEN layer = 'audio' AND condition LIKE '%Fluent%' THEN 'e_' || trial || '_f.wav'
    WHEN layer = 'audio' THEN 'e_' || trial || '_d.wav'
    WHEN layer = 'image-left' AND condition LIKE '%FillerL' THEN 'fr_' || trial || '.png'
    WHEN layer = 'image-right' AND condition LIKE '%FillerR' THEN 'fr_' || trial || '.png'
    WHEN layer = 'image-left' AND condition LIKE '%L' THEN 't_' || trial || '.png'
    WHEN layer = 'image-right' AND condition LIKE '%R' THEN 't_' || trial || '.png' END AS value
    FROM lists CROSS JOIN (VALUES ('image-left'), ('image-right'), ('audio')) l(layer))"""
PAIRED = f"""pools AS (SELECT greatest(1, count(*) // {POOL}) AS n FROM customer),
pool AS (SELECT 'd' || c_custkey || '.png' AS distractor, no % n AS pool_set, no // n AS pool_no FROM (
    SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS no FROM customer), pools),
sizes AS (SELECT pool_set, count(*) AS size FROM pool GROUP BY pool_set),
placed AS (SELECT list, trial, row_number() OVER (PARTITION BY list
    ORDER BY md5('{SEED}:' || list || ':' || trial), trial) AS place,
    CAST('0x' || substr(md5(list), 1, 8) AS BIGINT) % (SELECT n FROM pools) AS pool_set FROM (SELECT DISTINCT list, trial FROM lists)),
paired AS (SELECT placed.list, placed.trial, pool.distractor FROM placed JOIN sizes USING (pool_set)
    JOIN pool ON pool.pool_set = placed.pool_set AND pool.pool_no = (place - 1) % size)"""
SHUFFLED = f"""labelled AS (SELECT item_set || '_' || "group" || '_' || j AS list, trial, condition FROM sets
    CROSS JOIN (SELECT unnest(range(1, {REPLICAS + 1})) AS j)),
withchecks AS (SELECT * FROM labelled UNION ALL SELECT list, a.trial, 'attention' FROM
    (SELECT DISTINCT list FROM labelled) CROSS JOIN (VALUES ('att1'), ('att2'), ('att3'), ('att4')) a(trial)),
shuffled AS (SELECT list, trial, condition, row_number() OVER (PARTITION BY list
    ORDER BY md5('{SEED}:' || list || ':' || trial), trial) AS position,
    trial || ':' || CASE WHEN condition = 'attention' THEN '' ELSE list END || condition AS line FROM withchecks)"""


def critical_items(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("item"), F.col("p_partkey").alias("item_no")
    )


def filler_items(spark, sf):
    supplier = table(spark, sf, "supplier")
    return supplier.select(
        F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("item"), F.col("s_suppkey").alias("item_no")
    )


def everything(spark, sf):
    return de.latin_square(critical_items(spark, sf)).union(de.filler_square(filler_items(spark, sf)))


def sets(spark, sf):
    """All items in sets of a session's length."""
    critical = de.latin_square(de.item_sets(critical_items(spark, sf), CRITICAL))
    return de.with_fillers(critical, de.filler_square(de.item_sets(filler_items(spark, sf), FILLER)))


def lists(spark, sf):
    return de.expand_lists(sets(spark, sf), REPLICAS)


@query("e1_latin_square", f"WITH {ITEMS}, {SQUARE} SELECT * FROM square")
def e1(spark, sf):
    return de.latin_square(critical_items(spark, sf))


@query("e2_filler_square", f"WITH {FILLERS} SELECT * FROM fillers")
def e2(spark, sf):
    return de.filler_square(filler_items(spark, sf))


@query(
    "e3_balance_check",
    f"""WITH {EVERYTHING} SELECT g."group", c.condition, count(e.trial) AS n
    FROM (SELECT DISTINCT "group" FROM everything) g CROSS JOIN (SELECT DISTINCT condition FROM everything) c
    LEFT JOIN everything e ON e."group" = g."group" AND e.condition = c.condition GROUP BY ALL""",
)
def e3(spark, sf):
    return de.balance_check(everything(spark, sf))


@query("e4_expand_lists", f"WITH {LISTS} SELECT trial, list, condition FROM lists")
def e4(spark, sf):
    return lists(spark, sf).select("trial", "list", "condition")


@query("e5_assign_layer_values", f"WITH {LAYERED} SELECT trial, list, condition, layer, value FROM layered")
def e5(spark, sf):
    layers = de.assign_layer_values(de.expand_layers(lists(spark, sf)))
    return layers.select("trial", "list", "condition", "layer", "value")


def pairing(spark, sf):
    trials = spread(lists(spark, sf).select("list", "trial"), ["list"]).distinct()
    customer = numbered(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "no")
    pools = customer.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / POOL)).cast("long").alias("n")).scalar()
    pool = customer.withColumn("n", pools).select(
        F.pmod("no", "n").alias("pool_set"),
        F.floor(F.col("no") / F.col("n")).cast("long").alias("pool_no"),
        F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("distractor"),
    )
    return de.random_pairing(trials, pool, SEED)


@query("e6_random_pairing", f"WITH {LISTS}, {PAIRED} SELECT list, trial, distractor FROM paired")
def e6(spark, sf):
    return pairing(spark, sf)


@query(
    "j15_attach_distractors",
    f"""WITH {LAYERED}, {PAIRED} SELECT l.trial, l.list, l.condition, l.layer, coalesce(l.value, p.distractor) AS value
    FROM layered l LEFT JOIN paired p ON p.list = l.list AND p.trial = l.trial""",
)
def j15(spark, sf):
    layers = de.assign_layer_values(de.expand_layers(lists(spark, sf)))
    return de.attach_distractors(layers, pairing(spark, sf)).select("trial", "list", "condition", "layer", "value")


SHUFFLED_SQL = f"WITH {SETS}, {SHUFFLED} SELECT list, trial, condition, position, line FROM shuffled"


def ordered_lists(spark, sf):
    return de.shuffled_list(sets(spark, sf), SEED, REPLICAS)


@query("e7_shuffled_list", SHUFFLED_SQL)
def e7(spark, sf):
    return ordered_lists(spark, sf).select("list", "trial", "condition", "position", "line")


@query(
    "o3_seeded_shuffle",
    statement(
        """SELECT participant, seq, row_number() OVER (PARTITION BY participant
        ORDER BY md5('20:' || participant || ':' || seq), seq) AS position FROM ev""",
        "ev",
    ),
)
def o3(spark, sf):
    return de.seeded_shuffle(model_events(spark, sf).select("participant", "seq"), ["participant"], ["seq"], SEED)


@query(
    "j14_expand_grid",
    """SELECT p_partkey, c.condition FROM part CROSS JOIN
    (VALUES ('FluentL'), ('FluentR'), ('DisfluentL'), ('DisfluentR')) c(condition)""",
)
def j14(spark, sf):
    return de.expand_grid(table(spark, sf, "part").select("p_partkey"), de.CRITICAL_CONDITIONS, "condition")


@query(
    "r5_layer_expansion",
    """SELECT p_partkey, l.layer FROM part CROSS JOIN (VALUES ('image-left'), ('image-right'), ('audio')) l(layer)""",
)
def r5(spark, sf):
    return de.expand_layers(table(spark, sf, "part").select("p_partkey"))


@query("r6_row_replication", "SELECT p_partkey, CAST(unnest(range(1, 13)) AS INTEGER) AS replica FROM part")
def r6_rows(spark, sf):
    return de.replicate(table(spark, sf, "part").select("p_partkey"), 12)


@query(
    "trial_documents",
    f"""WITH {LAYERED}, {PAIRED} SELECT l.trial AS name, l.condition, l.layer, coalesce(l.value, p.distractor) AS value
    FROM layered l LEFT JOIN paired p ON p.list = l.list AND p.trial = l.trial""",
)
def trial_docs(spark, sf):
    """The nested trial documents written as JSON, read back and taken apart: every file of every layer."""
    layers = de.assign_layer_values(de.expand_layers(lists(spark, sf)))
    documents = de.trial_documents(de.attach_distractors(layers, pairing(spark, sf)))
    folder = scratch(spark, "trials")
    so.write_design(documents, folder)
    back = spark.read.schema(documents.schema).json(folder)
    conditions = back.select("name", F.explode("conditions").alias("c"))
    return conditions.select("name", F.col("c.name").alias("condition"), F.inline("c.variables"))


def scratch(spark, name: str) -> str:
    """A new folder for files of one run: in the cluster's shared folder, or local where none is named."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return f"{shared}/files-{uuid.uuid4().hex}/{name}"


def _export(df, columns: dict[str, tuple[str, str]], path: str, without: tuple[str, ...] = ()) -> None:
    """Write a table the way the logger exports it."""
    named = [F.col(name).alias(header) for header, (name, _) in columns.items() if header not in without]
    df.select(*named).write.csv(path, header=True, nullValue="NA")


EVENT_ROWS = """SELECT participant, trial, condition, layer, event_category, event_type, x, y, elapsed, trial_start,
    CASE WHEN participant % 2 = 0 THEN browser END AS browser, CASE WHEN participant % 2 = 0 THEN version END AS version,
    CASE WHEN participant % 2 = 0 THEN os END AS os, image_left, image_right, audio FROM client"""


@query("s1_read_events", statement(EVENT_ROWS, "client"))
def s1(spark, sf):
    """The event log as exports of two logger versions, one without client columns, read back together."""
    from tracelane.sources.files import EVENT_COLUMNS

    folder = scratch(spark, "events")
    events = with_client_columns(model_events(spark, sf))
    even = F.col("participant") % 2 == 0
    _export(events.filter(even), EVENT_COLUMNS, f"{folder}/v1")
    _export(events.filter(~even), EVENT_COLUMNS, f"{folder}/v2", ("Browser", "Version", "OS"))
    return so.read_events(spark, f"{folder}/*", "part-*.csv").drop("src_file", "seq")


@query("s2_read_questionnaire", statement("SELECT participant, question, answer FROM qs", "qs"))
def s2(spark, sf):
    from tracelane.sources.files import QUESTION_COLUMNS

    folder = scratch(spark, "questionnaire")
    _export(model_questionnaire(spark, sf), QUESTION_COLUMNS, folder)
    return so.read_questionnaire(spark, folder, "part-*.csv").drop("src_file", "seq")


@query("s3_read_durations", f"WITH {PARTS} SELECT file, {r6('p_retailprice')} AS duration FROM parts")
def s3(spark, sf):
    folder = scratch(spark, "durations")
    part_recordings(spark, sf).select("file", "duration").write.csv(folder)
    return so.read_durations(spark, folder)


@query("s4_read_roster", statement("SELECT mturk_id, batch, comments FROM roster", "roster"))
def s4(spark, sf):
    folder = scratch(spark, "roster")
    roster = model_roster(spark, sf).select(
        F.concat(F.lit("H"), F.col("seq").cast("string")).alias("HIT ID"),
        F.concat(F.lit("  "), F.col("mturk_id")).alias("WORKER ID"),
        F.lit("100% (1/1)").alias("HIT RATE"),
        F.col("comments").alias("COMMENTS"),
        F.col("batch").alias("BATCH"),
    )
    roster.write.csv(folder, header=True, sep="\t")
    return so.read_roster(spark, folder).select("mturk_id", "batch", "comments")


@query(
    "s5_file_catalogue",
    """WITH names AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 't_item' || p_partkey || '.png'
    WHEN 1 THEN 'fr_item' || p_partkey || '.png' WHEN 2 THEN 'd' || p_partkey || '.png'
    ELSE 'notes' || p_partkey || '.md' END AS file_name FROM part)
    SELECT file_name, CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'filler' WHEN 2 THEN 'distractor' END AS kind,
    CASE WHEN p_partkey % 4 < 2 THEN 'item' || p_partkey END AS item FROM names""",
)
def s5(spark, sf):
    number, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("t_item"), number, F.lit(".png")))
        .when(kind == 1, F.concat(F.lit("fr_item"), number, F.lit(".png")))
        .when(kind == 2, F.concat(F.lit("d"), number, F.lit(".png")))
        .otherwise(F.concat(F.lit("notes"), number, F.lit(".md")))
    )
    return so.classify_files(table(spark, sf, "part").select(name.alias("file_name")))


@query("s6_design_documents", f"WITH {SETS}, {SHUFFLED} SELECT list, position, line FROM shuffled")
def s6(spark, sf):
    """The list documents written as JSON, read back and taken apart."""
    folder = scratch(spark, "lists")
    so.write_design(de.list_documents(ordered_lists(spark, sf)), folder)
    rows = so.read_lists(spark, folder).select(F.col("name").alias("list"), F.posexplode("trials"))
    return rows.select("list", (F.col("pos") + 1).cast("long").alias("position"), F.col("col").alias("line"))


@query(
    "s7_stage_tables",
    statement(
        f"""SELECT CASE WHEN participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort, participant, trial, bin,
        {r6('refprop')} AS refprop FROM mv""",
        "mv",
    ),
)
def s7(spark, sf):
    folder = scratch(spark, "binned")
    rows = union_cohorts(**two_cohorts(model_trajectories(spark, sf)))
    so.write_table(rows.select("cohort", "participant", "trial", "bin", "refprop"), folder, ["cohort"])
    return so.read_table(spark, folder).select("cohort", "participant", "trial", "bin", "refprop")

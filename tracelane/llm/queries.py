"""One query for each operator of this folder, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import (
    chat,
    decontaminate,
    embeddings,
    licenses,
    minhash,
    packing,
    periods,
    quality,
    repair,
    slack,
    suffix,
    tokens,
    warc,
)
from tracelane.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query()
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


@_query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.prefix_counts(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@_query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"), capacity=4096, last=1)


@_query()
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    formatted = chat.conversations(chat.linear_trees(turns.union(extra)))
    return chat.read_back(formatted).withColumnRenamed("tree", "conv_id")


@_query()
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@_query()
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@_query()
def op10_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write(_table(spark, folder, "pages"), path, date="2026-01-01T00:00:00Z")
    read = warc.read(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    done = suffix.remove_repeats(documents, size=400, keep="none", whole_letters=False, full=True)
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["length"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),  # a run may cut a letter
    )


@_query()
def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"), cosine=0.95)


def fold(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


@_query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    seen = fold("doc_id") != 0
    scored = quality.score(documents, labels, fit=seen, calibrate=seen, group=fold("doc_id"))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@_query()
def op11_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return slack.pack(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=1024, last=0)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in a tenth of the rows the words from one on are copies of some words of the text in turn."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    blank = r"[\x20\x09-\x0D]+"
    chosen = docs.select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("chosen"))
    trimmed = F.regexp_replace("text", f"^{blank}|{blank}$", "")
    words = F.when(F.col("chosen") & (F.length(trimmed) > 0), F.split(trimmed, blank)).alias("w")
    cut = chosen.select("doc_id", "text", "g", words)
    cut = cut.withColumn("n", F.size("w").cast("long")).withColumn("a", F.col("g") % F.col("n"))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    n, a, p = (F.col(c).cast("int") for c in "nap")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), n - a)
    planted = F.concat_ws(" ", F.slice("w", F.lit(1), a), tail)
    return cut.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(planted).alias("text"))


@_query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_period(_table(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), -r["start"], -r["period"])))
    found = found.withColumn("best", best.cast("struct<length:long,start:long,period:long>"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``id, turn, role, text, rows``: conversations with planted faults; ``rows`` of a dropped row is 0."""
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        F.col("conv_id").alias("id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("rows"),
    )


@_query()
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    report, _ = repair.repair_counted(damaged(_table(spark, folder, "conversations")), "conv_id")
    return report

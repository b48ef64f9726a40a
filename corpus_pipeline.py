"""A training corpus from raw documents: each stage works on what its predecessor kept, written as Parquet between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import decontaminate, minhash, packing, quality, suffix
from tracelane.llm.common import sieved, stored
from tracelane.llm.queries import fold

QUALITY = 0.3
"""Documents with a lower score go."""
REPEAT_WORDS = 51
"""Later copies of passages of at least so many words go, however short the words are."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least ``QUALITY``."""
    labels = _table(spark, sf_dir, "labels")
    seen = fold("doc_id") != 0
    scored = quality.score(docs, labels, fit=seen, calibrate=seen, carry=True, group=fold("doc_id"))
    return scored.where(F.col("score") >= QUALITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Rows with equal ids and texts are one document.
    """
    marked = minhash.near_duplicates(docs)
    gone = marked.where("not kept").select("doc_id").distinct()
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(again.join(gone, "doc_id", "left_anti"))
    met = stored(gone.union(again))
    some, others = sieved(docs, met, "doc_id")
    once = others.union(some.join(met, "doc_id", "left_anti").select(*docs.columns))
    rest = some.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(rest.select(*docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages; those of which nothing but blanks is left go."""
    done = suffix.remove_repeats(docs, size=REPEAT_WORDS, keep="first", carry=True, words=True)
    left = F.col("kept").cast("string")
    text = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(left)
    cut = done.withColumn("left", text).where("kept is null or length(trim(left)) > 0")
    columns = {
        "text": F.col("left"),
        "n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(
            F.length("left").cast(docs.schema["n_chars"].dataType)
        ),
    }
    return cut.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth of the words."""
    judged = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), carry=True)
    return judged.where(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, last=1)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

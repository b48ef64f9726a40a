"""The composed pipeline on the smallest tables, and every registered query of the folder."""

import random

import corpus_pipeline
import pytest
from tracelane.llm import queries, suffix
from tracelane.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.STAGES[-1][0] == "packing"


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs, FOLDER).collect()


def test_repeats_are_counted_in_words(spark):
    short, long = [f"{k % 10}" for k in range(60)], [f"word{k:07}" for k in range(60)]
    rows = [(1, " ".join(["a", *short[:51], "b"])), (2, " ".join(["c", *short[:51], "d"]))]
    rows += [(3, " ".join(["e", *long[:50], "f"])), (4, " ".join(["g", *long[:50], "h"])), (5, "\n" + "\n".join(short[:51]))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: r for r in corpus_pipeline.drop_repeats(spark, docs, FOLDER).collect()}
    assert {i: r["text"] for i, r in left.items()} == {**dict(rows[:4]), 2: "c d"} and left[2]["n_chars"] == 3


def test_repeats_by_brute_force(spark):
    rng, n = random.Random(4), corpus_pipeline.REPEAT_WORDS
    say = lambda k: [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(k)]
    shared = [say(k) for k in (50, 51, 70, 300)]
    texts = []
    for _ in range(60):
        some = [w for _ in range(rng.randint(0, 3)) for w in [*say(rng.randint(0, 9)), *rng.choice(shared)[rng.choice([0, 0, 9]) :]]]
        texts.append("".join(w + rng.choice([" ", " ", "\n "]) for w in some))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w, gone = t.split(), set()
        for k in range(len(w) - n + 1):
            if (key := tuple(w[k : k + n])) in seen:
                gone |= set(range(k, k + n))
            seen.add(key)
        if not gone or len(gone) < len(w):
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    for hot in (1 << 30, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix, "HOT_BYTES", hot)
            left = corpus_pipeline.drop_repeats(spark, docs.repartition(3), FOLDER)
            assert {r["doc_id"]: r["text"].split() for r in left.collect() if r["text"]} == {i: w for i, w in want.items() if texts[i]}


def test_near_duplicates_drop_repeated_rows(spark):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, say(1)), (1, say(1)), (2, say(1) + " more"), (3, say(3)), (3, say(3)), (4, say(4)), (None, say(5)), (None, say(5))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4] and kept.count(None) == 2


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

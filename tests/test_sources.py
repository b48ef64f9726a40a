import pytest
from pyspark.sql import functions as F

from tracelane import sources as so


def test_versions_with_different_headers_stack_by_name(spark, tmp_path, rows):
    (tmp_path / "online-v1.csv").write_text(
        "Participant,Trial,Event Type,X,Browser\n1,lamp,move,10.5,img.png\n1,lamp,click,NA,\n", encoding="utf-8"
    )
    (tmp_path / "online-v2.csv").write_text(
        "Trial,X,Participant,image-left,other\nzoo,3,2,\"a, b.png\",7\n", encoding="utf-8"
    )
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    df = so.read_events(spark, str(tmp_path), "online-v*")
    assert dict(df.dtypes)["participant"] == "bigint" and dict(df.dtypes)["trial_start"] == "bigint"
    assert rows(df, "participant", "trial", "event_type", "x", "browser", "image_left", "src_file") == [
        (1, "lamp", "click", None, None, None, "online-v1.csv"),
        (1, "lamp", "move", 10.5, "img.png", None, "online-v1.csv"),
        (2, "zoo", None, 3.0, None, "a, b.png", "online-v2.csv"),
    ]
    with pytest.raises(FileNotFoundError):
        so.read_events(spark, str(tmp_path), "none*")


def test_sequence_follows_the_file_across_splits(spark, tmp_path):
    lines = [f"{i},q,{i}" for i in range(40_000)]
    (tmp_path / "v1.csv").write_text("Participant,Trial,X\n" + "\n".join(lines) + "\n")
    (tmp_path / "v2.csv").write_text("Participant,Trial,X\n" + "\n".join(lines[:500]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = so.read_events(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = df.filter("src_file = 'v1.csv'").orderBy("seq").select("participant").collect()
        assert df.select("seq").distinct().count() == 40_500
        assert df.groupBy().agg(F.max(F.when(F.col("src_file") == "v1.csv", F.col("seq"))) < F.min(F.when(F.col("src_file") == "v2.csv", F.col("seq")))).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r[0] for r in got] == list(range(40_000))


def test_one_header_opens_a_single_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"v{i}.csv").write_text(f"Participant,Question,Answers...\n{i},q,a\n")
    assert so.read_questionnaire(spark, str(tmp_path), "v*", one_header=True).count() == 3


def test_durations_and_roster(spark, tmp_path, rows):
    (tmp_path / "d.csv").write_text("e_lamp_f1.wav,1.25\np1.wav,2\n")
    assert rows(so.read_durations(spark, str(tmp_path / "d.csv"))) == [("e_lamp_f1.wav", 1.25), ("p1.wav", 2.0)]
    text = "HIT ID\tWORKER ID\tHIT RATE\tCOMMENTS\tBATCH\nH1\t  ZZTEST01\t100%\tcode X\tbatch 7\nH2\t\t1%\t\t\n"
    (tmp_path / "w.tsv").write_text(text, encoding="utf-8")
    assert rows(so.read_roster(spark, str(tmp_path / "w.tsv")), "mturk_id", "comments", "batch") == [
        ("ZZTEST01", "code X", "batch 7")
    ]


def test_catalogue_reads_names(spark, tmp_path, rows):
    for name in ["d1.png", "t_lamp.png", "fr_leaf.png", "readme.md"]:
        (tmp_path / name).write_text("x")
    assert rows(so.file_catalogue(spark, str(tmp_path))) == [
        ("d1.png", "distractor", None),
        ("fr_leaf.png", "filler", "leaf"),
        ("readme.md", None, None),
        ("t_lamp.png", "critical", "lamp"),
    ]


def test_stage_table_keeps_cohort_folders(spark, tmp_path):
    df = spark.createDataFrame([("LAB", 1), ("Mturk", 2)], "cohort string, n int")
    so.write_table(df, str(tmp_path / "t"), ["cohort"])
    back = so.read_table(spark, str(tmp_path / "t"))
    assert back.filter(F.col("cohort") == "LAB").first().n == 1


def test_swapped_columns_are_told_apart(spark, tmp_path, rows):
    (tmp_path / "a b.csv").write_text("Participant,Question,Answers...\n1,q,x\n")
    (tmp_path / "b.csv").write_text("\ufeffQuestion,\"Answers...\",Participant\nq,y,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    df = so.read_questionnaire(spark, str(tmp_path))
    assert rows(df, "participant", "answer", "src_file") == [(1, "x", "a b.csv"), (2, "y", "b.csv")]
    with pytest.raises(Exception, match="header|CSV"):
        so.read_questionnaire(spark, str(tmp_path), "[ab]*", one_header=True).collect()


def test_quoted_line_breaks_stay_in_their_answer(spark, tmp_path, rows):
    (tmp_path / "v1.csv").write_text('Participant,Question,Answers...\n1,why,"first ""line""\nsecond, line"\n2,why,no\n')
    assert rows(so.read_questionnaire(spark, str(tmp_path)), "participant", "answer") == [
        (1, 'first "line"\nsecond, line'),
        (2, "no"),
    ]


def test_first_answer_of_a_participant_in_two_files(spark, tmp_path, rows):
    from tracelane.operators.quality import questionnaire_answer

    filler = "".join(f"{i},other,{i}\n" for i in range(10, 400))
    (tmp_path / "v1.csv").write_text(f"Participant,Question,Answers...\n{filler}1,language,early\n")
    (tmp_path / "v2.csv").write_text("Question,Participant,Answers...\nlanguage,1,late\nlanguage,2,only\n")
    questions = so.read_questionnaire(spark, str(tmp_path)).repartition(5)
    assert rows(questionnaire_answer(questions, "language", "a")) == [(1, "early"), (2, "only")]

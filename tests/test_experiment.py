"""Two invented cohorts from CSV files to every report of the analysis."""

import random

from pyspark.sql import functions as F

from tracelane import sources as so
from tracelane.operators.clean import parse_durations
from tracelane.operators.quality import Thresholds
from tracelane.plans import experiment as ex

ITEMS = ["lamp", "boat", "tree"]
CONDITIONS = ["1_1FluentL", "1_1DisfluentR", "1_1FillerL"]
RULES = Thresholds(min_trials=3, min_critical=1, min_left=0, max_left=1)


def write_cohort(folder, prefix, first, people, seed):
    rng = random.Random(seed)
    lines = ["Participant,Trial,Condition,Layer,Event Category,Event Type,X,Y,Elapsed,Trial Start,image-right,Browser,Version,OS,image-left,audio"]

    def log(p, trial, code, layer, cat, kind, x, y, at, right=""):
        lines.append(f"{p},{trial},{code},{layer},{cat},{kind},{x},{y},{at},{1_700_000_000_000 + at},{right},B,V,O,,")

    for p in range(first, first + people):
        for trial, code in list(zip(ITEMS, CONDITIONS)) + [("att1", "attention"), ("att2", "attention")]:
            right = "atta.png" if trial.startswith("att") else "pic.png"
            log(p, trial, code, "audio", "audio", "playbackstart", "NA", "NA", 1000, right)
            x = 512
            for i in range(30):
                x += rng.choice([-9, -3, 0, 4, 10])
                log(p, trial, code, "", "mouse", "move", x, 350, 1900 + 17 * i, right)
            side = "image-right" if trial.startswith("att") or rng.random() < 0.5 else "image-left"
            log(p, trial, code, side, "mouse", "click", x, 350, 2500 + 10 * p % 70, right)
    (folder / f"{prefix}.csv").write_text("\n".join(lines) + "\n")
    answers = ["Participant,Question,Answers..."]
    for p in range(first, first + people):
        answers.append(f"{p},which language?,{'No - Only English' if p % 4 else 'Yes'}")
        answers.append(f"{p},MTurk id?,W{p // 2}")
    (folder / f"{prefix}-q.csv").write_text("\n".join(answers) + "\n")


def test_both_cohorts_to_reports(spark, tmp_path):
    write_cohort(tmp_path, "online-v1", 90, 6, seed=1)
    write_cohort(tmp_path, "lab-v1", 1, 4, seed=2)
    audio = "".join(f"{'f' if i == 2 else 'e'}_{item}_{['f1', 'd1', '1'][i]}.wav,1.0\n" for i, item in enumerate(ITEMS))
    (tmp_path / "audio.csv").write_text(audio)
    (tmp_path / "roster.tsv").write_text(
        "HIT ID\tWORKER ID\tHIT RATE\tCOMMENTS\tBATCH\n"
        + "".join(f"H\t  W{w}\t1\tok\tbatch {b}\n" for w, b in [(45, 1), (45, 2), (46, 1)])
    )
    durations = parse_durations(so.read_durations(spark, str(tmp_path / "audio.csv")))
    cohorts = {}
    for name, roster in [("online-v1", so.read_roster(spark, str(tmp_path / "roster.tsv"))), ("lab-v1", None)]:
        events = ex.clean_events(so.read_events(spark, str(tmp_path), f"{name}.csv"))
        questions = so.read_questionnaire(spark, str(tmp_path), f"{name}-q.csv")
        cohorts[name] = ex.build_cohort(
            events, questions, durations, roster, thresholds=RULES, store=str(tmp_path / f"stages-{name}")
        ).stored(spark, str(tmp_path / f"tables-{name}"))
    online, lab = cohorts["online-v1"], cohorts["lab-v1"]
    assert online.ppt_info.count() == 6 and online.ppt_trial_info.count() == 18
    assert {r.att_check for r in online.ppt_info.collect()} == {1.0}
    status = {r.participant: (r.duplicate, r.duplicate2, r.submitted) for r in online.ppt_info.collect()}
    assert status[90] == ("duplicate", "n-dup", "submitted")
    assert status[91] == ("duplicate", "duplicate", "submitted")
    assert status[92] == ("n-dup", "n-dup", "submitted") and status[94] == ("n-dup", "n-dup", "not submitted")
    assert online.tdat_binned.filter("condition = 'Filler'").count() == 0
    assert online.object_clicks.count() == 12
    assert online.tdat_binned.filter("include_ppt IS NULL").count() == 0

    whole = ex.merge_analysis(online, lab)
    # every lab session is shorter than the study's minimum and is left out
    assert {r.cohort for r in whole.ppt_info.select("cohort").distinct().collect()} == {"Mturk"}
    both = ex.merge_analysis(online, ex.CohortTables(**{
        f: getattr(lab, f).withColumn("total_trials", F.lit(60)) if "total_trials" in getattr(lab, f).columns else getattr(lab, f)
        for f in ("ppt_info", "ppt_trial_info", "tdat_binned", "object_clicks")
    }))
    reports = {name: df.collect() for name, df in ex.analysis_reports(both).items()}
    assert {r.cohort for r in reports["time_taken"]} == {"Mturk", "LAB"}
    assert sum(r.n for r in reports["clicked"]) == sum(r.n for r in reports["clicked_by_fluency"]) > 0
    assert {r.AOI for r in reports["movement"]} == {"refprop", "disprop"}
    assert {r.AOI for r in reports["fitted"]} == {"elog_bias", "fitted"}
    assert all(abs(r.mean_prop) <= 1 for r in reports["movement"] if r.mean_prop is not None)
    assert reports["slopes"] and reports["criteria"] and reports["inclusion"] and reports["hours"]
    assert {r.cohort for r in reports["invalid_trials"]} == {"Mturk", "LAB"}

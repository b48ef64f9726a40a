"""Interval sweeps, closed-form estimates, tables with empty cells, p values and the exact median."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelane.functions import chi_square_p
from tracelane.operators import aggregate as agg
from tracelane.operators import design as de
from tracelane.operators import intervals as iv
from tracelane.operators import model as mo
from tracelane.operators import resample as rs
from tracelane.operators import skew


def stretches(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        low = rng.randint(-3, 20)
        value = rng.choice([None, 0.0, round(rng.random(), 3)])
        out.append((rng.choice("ab"), rng.randint(1, 5), low, low + rng.choice([0, 0, 1, 5, 30]), value, float(rng.randint(0, 2))))
    return out


RUNS = "c string, s int, low long, high long, v double, w double"


def test_running_totals_are_sums_over_what_holds(spark):
    data = stretches(1)
    runs = spark.createDataFrame(data, RUNS)
    got = iv.running_totals(runs, ["c"], {"n": F.lit(1).cast("long"), "t": F.coalesce("v", F.lit(0.0))}).collect()
    want = {}
    for c, _, low, high, v, _ in data:
        for at in range(low, high + 1):
            n, t = want.get((c, at), (0, 0.0))
            want[c, at] = n + 1, t + (v or 0.0)
    seen = {(r.c, at): (r.n, r.t) for r in got if r.n for at in range(r.low, r.high + 1)}
    assert seen.keys() == want.keys()
    assert all(seen[k][0] == want[k][0] and abs(seen[k][1] - want[k][1]) < 1e-9 for k in want)
    assert iv.running_totals(runs.limit(0), ["c"], {"n": F.lit(1)}).count() == 0


def test_sums_of_places(spark):
    df = spark.createDataFrame([(a, b) for a in range(-5, 5) for b in range(a, 9)] + [(3, 2 * 10**9)], "a long, b long")
    for r in df.select("*", iv.sum_of_places(F.col("a"), F.col("b")).alias("s"), iv.sum_of_squares(F.col("a"), F.col("b")).alias("q")).collect():
        up = lambda k: k * (k + 1) * (2 * k + 1) // 6
        assert int(r.s) == (r.a + r.b) * (r.b - r.a + 1) // 2 and int(r.q) == up(r.b) - up(r.a - 1)


@pytest.mark.parametrize("na", ["propagate", "skip"])
def test_timecourse_of_runs_equals_that_of_the_grid(spark, rows, na):
    runs = spark.createDataFrame(stretches(2), RUNS)
    grid = iv.spread(runs, F.col("low"), F.col("high")).withColumnRenamed("__at", "bin")
    columns = ["c", "bin", "AOI", "mean_prop", "se", "low", "up", "time"]
    want = rows(agg.timecourse(grid, ["v", "w"], "s", ["c"], na=na), *columns)
    got = rows(agg.timecourse_of_runs(runs, ["v", "w"], "s", ["c"], na=na), *columns)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want):
        assert all(a == b if a is None or b is None else abs(a - b) < 1e-6 for a, b in zip(g[3:], w[3:])), (g, w)


def test_estimates_of_runs_equal_those_of_the_grid(spark, rows):
    data = [(c, s, abs(low), abs(low) + high - low, v, 0.0) for c, s, low, high, v, _ in stretches(3)] + [("a", 9, 4, 4, 0.5, 0.0)]
    runs = spark.createDataFrame(data, RUNS)
    moments = mo.bin_moments(runs)
    grid = iv.spread(runs, F.col("low"), F.col("high")).withColumnRenamed("__at", "bin")
    frame = grid.select("c", F.col("s").alias("sub"), F.col("v").alias("elog_bias"), "bin", mo.standardised("bin", moments).alias("time_z"))
    times = [b for _, _, low, high, _, _ in data for b in range(low, high + 1)]
    mean = sum(times) / len(times)
    sd = math.sqrt(sum((t - mean) ** 2 for t in times) / (len(times) - 1))
    for r in frame.select("bin", "time_z").distinct().collect():
        assert abs(r.time_z - (r.bin - mean) / sd) < 1e-9
    named = runs.withColumnsRenamed({"s": "sub", "v": "elog_bias"})
    slopes = mo.subject_slopes(frame, "elog_bias", "time_z", ["c"])
    near = lambda a, b: a == b if a is None or b is None else abs(a - b) < 1e-6
    want, got = rows(slopes, "c", "sub", "n", "slope", "intercept"), rows(mo.slopes_of_runs(named, "elog_bias", ["c"], moments), "c", "sub", "n", "slope", "intercept")
    assert len(want) == len(got) and all(near(a, b) if not isinstance(a, str) else a == b for g, w in zip(got, want) for a, b in zip(g, w))
    columns = ["c", "AOI", "bin", "mean_prop", "se"]
    want = rows(mo.fitted_timecourse(frame, slopes, ["c"]), *columns)
    got = rows(mo.fitted_of_runs(named, ["c"]), *columns)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(near(g[3], w[3]) and near(g[4], w[4]) for g, w in zip(got, want))


def test_steady_runs_spread_to_the_trajectories(spark, rows):
    rng = random.Random(6)
    log, seq = [], 0
    for p in range(1, 5):
        for trial, start in (("lamp", 300.0), ("boat", 1500.0)):
            seq += 1
            log.append((p, trial, seq, "Fluent", "LR"[p % 2], "audio", "playbackstart", 200.0, None, None))
            for i in range(12):
                seq += 1
                x = None if rng.random() < 0.2 else float(rng.randint(-50, 50))
                log.append((p, trial, seq, "Fluent", "LR"[p % 2], "mouse", "move", start + 37.0 * i * i, x, 1.0))
    schema = "participant long, trial string, seq long, condition string, refpos string, event_category string, event_type string, elapsed double, x double, y double"
    events = spark.createDataFrame(log, schema)
    durations = spark.createDataFrame([("Fluent", "lamp", 200.0), ("Fluent", "boat", 100.0)], "condition string, item string, audio1_duration double")
    columns = ["participant", "trial", "bin", "x", "y", "cumulative_distance", "ref_cdist", "refprop", "disprop"]
    runs = rs.steady_runs(events, durations)
    got = iv.spread(runs, F.col("low"), F.col("high")).withColumnRenamed("__at", "bin")
    want = rows(rs.trajectories(events, durations), *columns)
    assert rows(got, *columns) == want and len(want) > 400
    spans = rows(rs.grid_spans(events, durations), "participant", "trial", "low", "high")
    ends = {}
    for p, t, b, *_ in want:
        low, high = ends.get((p, t), (b, b))
        ends[p, t] = min(low, b), max(high, b)
    assert {(p, t): (low, high) for p, t, low, high in spans} == ends


def test_p_values(spark):
    cases = [(x, k) for x in (0.0, 1e-6, 0.1, 1.0, 3.84, 10.0, 80.0, 400.0) for k in (1, 2, 3, 4, 5, 8, 51, 200)]
    df = spark.createDataFrame(cases + [(None, 2), (1.0, 0)], "x double, k long").withColumn("p", chi_square_p("x", "k"))
    for r in df.collect():
        if r.x is None or not r.k:
            assert r.p is None
            continue
        h = r.x / 2
        if r.k % 2:  # upper tail by its finite sums
            want = math.erfc(math.sqrt(h)) + sum(math.exp(-h + (j - 0.5) * math.log(h) - math.lgamma(j + 0.5)) for j in range(1, (r.k - 1) // 2 + 1) if h)
        else:
            want = sum(math.exp(-h + j * math.log(h) - math.lgamma(j + 1)) if h else float(j == 0) for j in range(r.k // 2))
        assert abs(r.p - want) < 1e-11 + 1e-9 * want, (r, want)


def test_empty_cells_are_shown(spark, rows):
    df = spark.createDataFrame([("x", "ref"), ("x", "dis"), ("y", "ref"), ("z", None)], "f string, c string")
    assert rows(agg.freq_table(df, ["f", "c"], ["f"])) == [("x", "dis", 1, 0.5), ("x", "ref", 1, 0.5), ("y", "dis", 0, 0.0), ("y", "ref", 1, 1.0)]
    table = agg.strat_table(df.filter("f <> 'z'"), "f", ["c"])
    assert rows(table, "level", "stratum", "n", "percent", "dof") == [("dis", "x", 1, 50.0, 1), ("dis", "y", 0, 0.0, 1), ("ref", "x", 1, 50.0, 1), ("ref", "y", 1, 100.0, 1)]
    assert {round(r.p, 6) for r in table.collect()} == {1.0}
    holed = de.latin_square(spark.range(20).selectExpr("concat('c', id) AS item", "id AS item_no")).filter("NOT (`group` = 2 AND condition = 'FluentL')")
    assert [r for r in rows(de.balance_check(holed)) if r[2] != 5] == [(2, "FluentL", 0)]
    assert agg.freq_table(df.limit(0), ["f", "c"]).count() == 0


def test_median_by_rank(spark, monkeypatch):
    big = spark.range(0, 1_000_001, 1, 8).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    small = spark.createDataFrame([("b", 1.0)] * 3 + [("b", 5.0)] * 3 + [("b", None), (None, 2.0), ("c", None)], "g string, v double")
    blocks = {}

    def kept(rows, order, cut=skew.range_blocks):
        blocks["all"] = cut(rows, order)
        return blocks["all"]

    monkeypatch.setattr(agg, "range_blocks", kept)
    got = {r.g: r.median for r in agg.exact_median(big.union(small), ["g"], "v").collect()}
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_001))
    assert got == {"a": float(values[500_000]), "b": 3.0, None: 2.0}
    sizes = [r["count"] for r in blocks["all"].groupBy("__block").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 700_000  # no block holds a group's values


def test_regression_agrees_with_spark_ml(spark):
    rng = random.Random(3)
    data = []
    for _ in range(600):
        a, b = rng.choice([-0.5, 0.5]), float(rng.randint(0, 4))
        data.append((a, b, "ref" if rng.random() < 1 / (1 + math.exp(-(0.3 + 0.9 * a - 0.2 * b))) else "dis"))
    clicks = spark.createDataFrame(data + [(0.5, None, "ref"), (None, 1.0, "dis"), (0.5, 1.0, None)], "a double, b double, clicked string")
    found = {r.term: r for r in mo.choice_regression(clicks, ["a", "b"]).collect()}
    fit = mo.choice_glm(clicks.dropna(), ["a", "b"])
    errors = fit.summary.coefficientStandardErrors
    for i, term in enumerate(["a", "b"]):
        assert abs(found[term].estimate - fit.coefficients[i]) < 1e-5 and abs(found[term].se - errors[i]) < 1e-5
    assert abs(found["intercept"].estimate - fit.intercept) < 1e-5
    apart = spark.createDataFrame([(0.5, "ref"), (-0.5, "dis")] * 5, "a double, clicked string")
    assert {r.estimate for r in mo.choice_regression(apart, ["a"], 40).collect()} == {None}
    same = clicks.withColumn("b", F.col("a"))
    assert {r.se for r in mo.choice_regression(same, ["a", "b"]).collect()} == {None}

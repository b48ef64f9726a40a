"""The registered queries: naming, SQL partners, and a sample of results at the smallest scale."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a11_two_level_timecourse",
    "a14_stratified_table",
    "d10_participant_inclusion",
    "d13_resolve_duplicates",
    "d6_trajectories",
    "e6_random_pairing",
    "j16_natural_join_null_keys",
    "s6_design_documents",
    "w8_lag1_autocorrelation",
]


def plain(value):
    return "~" if value is None else repr(round(value, 5) + 0.0) if isinstance(value, float) else str(value)


def test_every_query_has_its_sql():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.LLM_ORACLES)
    assert len(own) > 100


def test_every_operator_of_the_inventory_has_a_query():
    prefixes = {re.match(r"[a-z]+\d+", name).group() for name in entry.queries() if re.match(r"[a-z]+\d+", name)}
    want = {f"{family}{i}" for family, n in {"p": 15, "a": 20, "d": 16, "e": 7, "m": 3, "s": 7, "w": 8, "r": 6, "u": 3, "o": 3, "f": 8, "j": 16, "x": 11}.items() for i in range(1, n + 1)}
    assert want <= prefixes


@pytest.mark.parametrize("name", SAMPLE)
def test_result_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs and mine


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["condition", "bin", "AOI", "mean_prop", "se", "low", "up", "time"]
    assert out.count() > 0

"""Merging cohorts and choosing the analysis population."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the study: smallest complete lab session, last participant id of the online pilot
MIN_LAB_TRIALS = 55
MAX_PILOT_ID = 87


def cohort_exclusion(min_lab: int = MIN_LAB_TRIALS, max_pilot_id: int = MAX_PILOT_ID) -> Column:
    """True for rows to keep: not an incomplete lab session and not an online pilot id."""
    incomplete = (F.col("total_trials") <= min_lab) & (F.col("cohort") == "LAB")
    pilot = (F.col("cohort") == "Mturk") & (F.col("participant").cast("double") <= max_pilot_id)
    return ~incomplete & ~pilot


def analysis_population(language: str = "Monolingual") -> Column:
    """True for first-time valid participants of one language group."""
    return (
        (F.col("bilingual2") == language)
        & (F.col("duplicate2") == "n-dup")
        & (F.col("include_ppt") == "valid")
    )


def union_cohorts(**cohorts: DataFrame) -> DataFrame:
    """Stack cohorts by column name (missing columns become null) with the cohort's name as a column."""
    tagged = [df.withColumn("cohort", F.lit(name)) for name, df in cohorts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_cohorts(keep: Column | None = None, **cohorts: DataFrame) -> DataFrame:
    """Union, then the cohort exclusions."""
    return union_cohorts(**cohorts).filter(cohort_exclusion() if keep is None else keep)

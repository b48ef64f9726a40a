"""Every operator as a query over the shared tables, next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# the queries without the rounding that only serves the comparison
UNROUNDED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places without a negative zero, so that summation order cannot show."""
    kinds = dict(df.dtypes)
    doubles = [c for c, kind in kinds.items() if kind == "double"]
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        UNROUNDED[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tracelane.plans import queries_design, queries_rows, queries_summary, queries_trials  # noqa: F401

"""Cleaning and parsing of raw event and side tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions import code_values, condition_name, condition_side, matches, na_text, number_text
from tracelane.functions.scalar import level_code

# fixed values: screen geometry in pixels
SCREEN_WIDTH = 1024
CENTRE_X = 512
CENTRE_Y = 350
IMAGE_WIDTH = 150
IMAGE_INSET = 0.15

# fixed values: columns that older logger versions wrote one place to the side
SHIFTED = {"image_left": "browser", "image_right": "version", "audio": "os"}


def outer_edge() -> float:
    """Distance of the images' outer edge from the screen centre."""
    return SCREEN_WIDTH / 2 - (IMAGE_INSET * SCREEN_WIDTH - IMAGE_WIDTH / 2)


def coalesce_shifted(df: DataFrame, columns: dict[str, str] = SHIFTED) -> DataFrame:
    """Fill each column from the one its values were shifted into."""
    return df.withColumns({to: F.coalesce(F.col(to), F.col(source)) for to, source in columns.items()})


def recentre(df: DataFrame, cx: float = CENTRE_X, cy: float = CENTRE_Y) -> DataFrame:
    return df.withColumns({"x": F.col("x") - F.lit(cx), "y": F.col("y") - F.lit(cy)})


def parse_condition(df: DataFrame, code: str = "condition") -> DataFrame:
    """Split a condition code into ``condition`` (name) and ``refpos`` (side of the referent)."""
    side, name = condition_side(code), condition_name(code)
    return df.withColumns({"refpos": side, "condition": name})


def parse_durations(df: DataFrame) -> DataFrame:
    """First fragments of the recordings: ``condition``, ``item`` and the duration in milliseconds."""
    file = F.col("file")
    first = df.filter(matches(file, "1.wav") & ~matches(file, "p1.wav"))
    condition = F.when(matches(file, "f1.wav"), "Fluent").when(matches(file, "d1.wav"), "Disfluent")
    out = first.withColumn("condition", condition.otherwise("Filler"))
    # a two-character prefix, then the item, then "_1.wav" or "_f1.wav"/"_d1.wav"
    tail = F.when(F.col("condition") == "Filler", F.lit(6)).otherwise(F.lit(7))
    return out.select(
        (F.col("duration") * F.lit(1000)).alias("audio1_duration"),
        F.substring(file, F.lit(3), F.length(file) - tail - F.lit(2)).alias("item"),
        "condition",
    )


def flag_outside(df: DataFrame, edge: float | None = None) -> DataFrame:
    """1 when the cursor is beyond the outer edge, 0 when not, null without a position."""
    limit = F.lit(outer_edge() if edge is None else float(edge))
    away = F.abs(F.col("x")) > limit
    return df.withColumn("outside", F.when(away, 1).when(~away, 0))


def tag_cohort(df: DataFrame, cohort: str, column: str = "participant") -> DataFrame:
    """Mark the cohort in the id itself (``LAB_7``)."""
    return df.withColumn(column, F.concat(F.lit(cohort + "_"), F.col(column).cast("string")))


def split_cohort(df: DataFrame, column: str = "participant") -> DataFrame:
    """Undo ``tag_cohort``: a ``cohort`` column and the bare id (as text)."""
    parts = F.split(F.col(column), "_")
    return df.withColumns({"cohort": parts[0], column: parts[1]})


def map_columns(df: DataFrame, pattern: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column whose name contains ``pattern``."""
    return df.withColumns({c: fn(F.col(c)) for c in df.columns if pattern in c})


def contrast_code(df: DataFrame, col: str, codes: dict[str, float], name: str | None = None) -> DataFrame:
    """Numeric contrast of a factor, the listed levels being all that are kept in use."""
    return df.withColumn(name or f"{col}_c", code_values(col, codes))


def treatment_code(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """0/1 column per level after the reference level, and the ordered level number."""
    out = {f"{col}_code": level_code(col, levels)}
    for level in levels[1:]:
        out[f"{col}_{level}"] = code_values(col, {v: float(v == level) for v in levels})
    return df.withColumns(out)


def status_label(df: DataFrame, cols: list[str], sep: str = " : ", name: str = "dup_incl") -> DataFrame:
    """Join columns into one label, spelling null as ``NA`` and numbers without trailing zeros."""
    kinds = dict(df.dtypes)
    parts = [number_text(c) if kinds[c] == "double" else na_text(c) for c in cols]
    return df.withColumn(name, F.concat_ws(sep, *parts))


def clip_axes(
    df: DataFrame,
    x: str,
    y: str,
    xlim: tuple[float, float] = (0, 2000),
    ylim: tuple[float, float] = (0, 1),
) -> DataFrame:
    """Rows inside the window of a plot."""
    return df.filter(F.col(x).between(*xlim) & F.col(y).between(*ylim))

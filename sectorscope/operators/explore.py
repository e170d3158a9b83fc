"""Explorer operators: label filter, free-text search, previews.

All are filters or bounded top-N; none collects rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.operators.profiles import ARCH, non_error_rows

# Fixed value: the display column preferred by the preview tables.
DISPLAY_NAME = "Organization Name"


def filter_labels(df: DataFrame, labels: Sequence[str], col: str = ARCH) -> DataFrame:
    """Keep rows whose label is in ``labels``; an empty selection keeps everything."""
    return df.filter(F.col(col).isin(*labels)) if labels else df


def filter_counts(df: DataFrame, labels: Sequence[str], col: str = ARCH, pattern: str | None = None,
                  literal: bool = False) -> DataFrame:
    """Shown vs total rows in one pass: shown are those that pass the labels and, if given, the search."""
    shown = F.coalesce(F.col(col).isin(*labels), F.lit(False)) if labels else F.lit(True)
    if pattern is not None:
        shown = shown & matches(df.columns, pattern, literal)
    return df.agg(F.count_if(shown).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def search(df: DataFrame, pattern: str, literal: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column's string form matches ``pattern`` case-insensitively.

    ``pattern`` is a Java regex unless ``literal``; null cells never match.
    """
    return df.filter(matches(columns or df.columns, pattern, literal))


def matches(columns: Sequence[str], pattern: str, literal: bool = False) -> Column:
    """The test of ``search``."""
    cols = list(columns)
    if literal:
        needle = F.lit(pattern.lower())
        tests = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(needle), F.lit(False)) for c in cols]
    else:
        rx = "(?iu)" + pattern  # case-insensitive for all letters, as Python's re
        tests = [F.coalesce(F.col(f"`{c}`").cast("string").rlike(rx), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, tests)


def display_column(df: DataFrame) -> str:
    return DISPLAY_NAME if DISPLAY_NAME in df.columns else df.columns[0]


def recent(df: DataFrame, order_col: str, n: int = 10) -> DataFrame:
    """First ``n`` rows in input (id) order: display name, label, confidence, wave."""
    wave = "Innovation_Wave" if "Innovation_Wave" in df.columns else "Keywords_Found"
    cols = list(dict.fromkeys([display_column(df), order_col, ARCH, "Confidence_Score", wave]))
    return df.select(*cols).orderBy(order_col).limit(n)


def head_per_label(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """First ``n`` non-error rows of every label.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so a label holding most rows still ships at most ``n`` rows per task.
    """
    w = Window.partitionBy(ARCH).orderBy(order_col)
    cols = list(dict.fromkeys([display_column(df), order_col, ARCH, "Confidence_Score", "Keywords_Found"]))
    rows = non_error_rows(df).filter(F.col(ARCH).isNotNull()).select(*cols)
    ranked = rows.withColumn("rn", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rn") <= n)

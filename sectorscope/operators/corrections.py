"""Founding year and the age correction.

The year column is chosen at plan time by name. Whether a string column is
read as numbers or as dates is a whole-column decision (at least 30% of the
rows must parse as numbers); that is one small aggregate, a scalar subquery
inside the same query, so building the plan runs no job. Date and timestamp
columns skip it and use ``year()``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that mark a year column, the share of numeric
# values below which dates are tried, the labels and the default cutoff.
YEAR_NAME_FRAGMENTS = ["founded", "founding", "year", "establishment", "launch"]
NUMERIC_SHARE = 0.3
YOUNG_LABELS = ["Disruptors", "Innovators"]
CORRECTED_LABEL = "Traditional / Generalist"
DEFAULT_CUTOFF = 2010
# End of fixed values.

# Our explicit date formats for the date fallback (tried in order).
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy",
                "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM", "MMM d, yyyy", "d MMM yyyy", "yyyy",
                "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "MMMM yyyy"]


def year_column(columns: Sequence[str], fragments: Sequence[str] = YEAR_NAME_FRAGMENTS) -> str | None:
    """First column whose lower-cased name contains a fragment."""
    for c in columns:
        if any(f in c.lower() for f in fragments):
            return c
    return None


def _date_year(c: Column) -> Column:
    return F.year(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]))


def founding_year(df: DataFrame, column: str | None = None) -> DataFrame:
    """Add ``Founded_Year DOUBLE`` (null where nothing parses)."""
    col_name = column or year_column(df.columns)
    if col_name is None:
        return df.withColumn("Founded_Year", F.lit(None).cast("double"))
    c = F.col(f"`{col_name}`")
    dtype = df.schema[col_name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn("Founded_Year", F.year(c).cast("double"))
    if isinstance(dtype, T.NumericType):
        return df.withColumn("Founded_Year", c.cast("double"))
    numeric = F.expr(f"try_cast(`{col_name}` AS DOUBLE)")
    # whole-column choice as a scalar subquery: one row, computed once inside
    # the query (column pruning leaves it a scan of the year column)
    use_numbers = df.agg(F.count(numeric) >= F.count(F.lit(1)) * F.lit(NUMERIC_SHARE)).scalar()
    year = F.when(use_numbers, numeric).otherwise(_date_year(c).cast("double"))
    return df.withColumn("Founded_Year", year)


def age_correction(df: DataFrame, cutoff: float = DEFAULT_CUTOFF, arch_col: str = "Predicted_Archetype",
                   labels: Sequence[str] = YOUNG_LABELS) -> DataFrame:
    """Young-model labels on companies founded before ``cutoff`` become generalists.

    Expects ``Founded_Year``; sets ``Age_Corrected`` to true on changed rows, null elsewhere.
    """
    hit = F.col(arch_col).isin(*labels) & (F.col("Founded_Year") < F.lit(cutoff))
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({
        arch_col: F.when(hit, F.lit(CORRECTED_LABEL)).otherwise(F.col(arch_col)),
        "Age_Corrected": F.when(hit, F.lit(True)),
    })

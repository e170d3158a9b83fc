"""Column expressions that build the per-row text, name and industry fields.

All column choices happen at plan time against ``df.columns``; the row work
is plain Spark expressions (``concat_ws`` skips nulls, ``coalesce`` picks the
first non-null), so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default column names consulted by the row classifier, in order.
AUX_TEXT_COLUMNS = ["Industries", "Industry Groups", "Full Description", "Description"]
NAME_COLUMNS = ["Company", "Name", "Organization", "company_name"]
INDUSTRY_COLUMNS = ["Industries", "Industry Groups"]
UNKNOWN_COMPANY = "Unknown Company"
# End of fixed values.


def _s(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def text_columns(columns: Sequence[str], main: str, aux: Sequence[str] = AUX_TEXT_COLUMNS) -> list[str]:
    """Main column first, then each existing auxiliary column other than the main one."""
    parts = [main] if main in columns else []
    parts += [c for c in aux if c in columns and c != main]
    return parts


def combined_text(df: DataFrame, main: str, aux: Sequence[str] = AUX_TEXT_COLUMNS) -> Column:
    cols = text_columns(df.columns, main, aux)
    if not cols:
        return F.lit("")
    return F.concat_ws(" ", *[_s(c) for c in cols])


def company_name(df: DataFrame, candidates: Sequence[str] = NAME_COLUMNS) -> Column:
    present = [_s(c) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(UNKNOWN_COMPANY))


def industries(df: DataFrame, candidates: Sequence[str] = INDUSTRY_COLUMNS) -> Column:
    present = [_s(c) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``\\b\\w+\\b`` words, Unicode-aware like Python's ``re``."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def has_word(text: Column) -> Column:
    """True when the text has at least one word (any word character)."""
    return text.rlike(r"(?U)\w")

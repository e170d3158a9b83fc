"""File sources and sinks for company tables.

CSV is read with every column as a string (no "5" turning into "5.0"), then null
tokens are mapped to null; ``infer_types`` gives the columns the types that all
their values have. Parquet and JSON keep their own types. Sinks write
partitioned, columnar output.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.sources.csv_ranges import scan_csv

# The strings read as null (pandas' CSV defaults), in its order.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# End of fixed values.

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """Format from the extension; unknown extensions are an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".xls", ".xlsx"):
        raise ValueError("Excel is not supported; export the sheet as CSV or Parquet")
    if ext not in FORMATS:
        raise ValueError(f"unsupported file format {ext!r}; use CSV, JSON or Parquet")
    return FORMATS[ext]


def scan(spark: SparkSession, path: str, fmt: str | None = None,
         columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Read a company table; CSV columns are all strings, null tokens become null.

    CSV files are cut into ranges that are read in many tasks, also where
    quoted cells hold line breaks; ``multi_line=False`` takes every line for a
    record. Columns go by name in each file, so files of a folder may order
    them differently or lack some (null there); ``columns`` names them by
    position instead, for all files alike.
    """
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return null_normalise(scan_csv(spark, path, columns, multi_line))
    if fmt == "json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def null_normalise(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """String cells equal to a null token (exactly, no trimming) become null."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c)
                       if c in strings else F.col(f"`{c}`") for c in df.columns])


# The type lattice: one bit for each type that a value may have; a column's types are those of all its values.
INTEGER, FLOAT, BOOLEAN = 1, 2, 4


def type_bits(value: Column) -> Column:
    """The types a string can have: a float may be any number, an integer one of digits that fits a long."""
    integer = value.rlike(r"^[+-]?[0-9]{1,19}$") & value.try_cast("bigint").isNotNull()
    number = value.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    truth = F.lower(value).isin("true", "false")
    return (F.when(integer, INTEGER + FLOAT).when(number, FLOAT).when(truth, BOOLEAN).otherwise(0)).cast("int")


def infer_types(df: DataFrame) -> DataFrame:
    """``df`` with every string column in the narrowest type that all its values have: long, double, boolean or string.

    One aggregate over all rows (a bitwise and per column, so parts merge in any order) and one projection. Nulls fit
    every type; a column without a value stays a string. Columns of other types stay as they are.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    found = df.agg(*[F.bit_and(F.when(F.col(f"`{c}`").isNotNull(), type_bits(F.col(f"`{c}`")))).alias(str(i))
                     for i, c in enumerate(strings)]).first()
    target = {}
    for c, bits in zip(strings, found):
        target[c] = ("string" if not bits else "bigint" if bits & INTEGER else "double" if bits & FLOAT else "boolean")
    return df.select(*[F.col(f"`{c}`").cast(target.get(c, df.schema[c].dataType)).alias(c) for c in df.columns])


def column_mapping(columns: Sequence[str], rule: str = "app") -> tuple[str, str]:
    """(name column, description column) by the default rules.

    ``app``: name = first column; description = first column whose name
    contains "description" (any case), else the second column.
    ``upload``: name = first column; description = the second column.
    Both clamp to the last column for one-column tables.
    """
    cols = list(columns)
    if not cols:
        raise ValueError("table has no columns")
    idx = 1
    if rule == "app":
        idx = next((i for i, c in enumerate(cols) if "description" in c.lower()), 1)
    return cols[0], cols[min(idx, len(cols) - 1)]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def run_id(at: Column) -> Column:
    """Run id of a time, e.g. ``20261202_0915``, in the session's time zone."""
    return F.date_format(at, "yyyyMMdd_HHmm")


def run_id_now() -> str:
    """Run id of the current time (UTC), in the form of ``run_id``."""
    from datetime import datetime, timezone
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M")


def export_results(df: DataFrame, base: str, mode: str, run_id: str | None = None, fmt: str = "parquet") -> str:
    """Write one run's results under ``base/mode=<mode>/run_id=<run_id>``.

    Runs and modes become partition values instead of file-name suffixes, so
    readers prune to one run and re-running a run replaces only its folder.
    """
    run_id = run_id or run_id_now()
    out = df.withColumns({"mode": F.lit(mode), "run_id": F.lit(run_id)})
    w = (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("mode", "run_id"))
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(base)
    else:
        w.parquet(base)
    return f"{base.rstrip('/')}/mode={mode}/run_id={run_id}"

"""The global place of each row in its input: files by path, ranges by offset, rows as they stand.

No row is sorted or shuffled: a row's number inside its file (Parquet) or range
(CSV) comes from the scan, and the rows before that file or range are a prefix
sum over counts, one small row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorscope.sources.csv_ranges import scan_csv
from sectorscope.sources.files import format_of, null_normalise

POSITION = "_position"


def scan_with_position(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV or Parquet table with ``_position``: 0 for the first row of the first file, then on without gaps."""
    fmt = fmt or format_of(path)
    if fmt == "csv":
        data = null_normalise(scan_csv(spark, path, multi_line=multi_line, places=True))
        keys, nth = ["_file", "_start"], "_nth"
    elif fmt == "parquet":
        data = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"),
                                               F.col("_metadata.row_index").alias("_nth"))
        keys, nth = ["_file"], "_nth"
    else:
        raise ValueError(f"no positions for {fmt!r}")
    counts = data.groupBy(*keys).agg((F.max(nth) + 1).alias("n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = data.join(bases, keys).withColumn(POSITION, F.col("_base") + F.col(nth))
    return placed.drop("_file", "_start", "_nth", "_base")


def first_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows in input order, a bounded top-N."""
    return df.orderBy(POSITION).limit(n)


def positional_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of equal position side by side; columns of one name keep the left one's."""
    shared = [c for c in right.columns if c in left.columns and c != POSITION]
    return left.join(right.drop(*shared), POSITION, how)

"""Profiles kept up to date: an additive cube of row counts, one set of signed rows a batch.

Each batch adds the cube of its rows (``profiles.profile_cube``) to a folder,
under its own number, so a batch that is written again replaces itself. When a
row's label changes later (an age correction, an answer that came after a
resume), a correction batch subtracts the cube of the rows as they were and
adds that of the rows as they are. Findings and counts then read the small
folder only, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.operators import profiles as pf

KEYS = ["label", "wave", "has_sec", *pf.DC_CODES]
_SCHEMA = f"label string, wave string, has_sec boolean, {', '.join(f'{c} int' for c in pf.DC_CODES)}, n bigint, batch bigint"


def _signed(df: DataFrame, sign: int) -> DataFrame:
    cube, cols = pf.profile_cube(df)
    if cols != pf.DC_CODES:
        raise ValueError(f"capability columns {cols}; the cube has {pf.DC_CODES}")
    return cube.select("label", "wave", "has_sec", *[F.col(c).cast("int").alias(c) for c in cols],
                       (F.col("n") * sign).cast("bigint").alias("n"))


def _write(rows: DataFrame, path: str, batch: int) -> None:
    (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))


def add_batch(df: DataFrame, path: str, batch: int) -> None:
    """Count the rows of ``df`` as batch number ``batch``."""
    _write(_signed(df, 1), path, batch)


def correct(before: DataFrame, after: DataFrame, path: str, batch: int) -> None:
    """Replace rows counted earlier: ``before`` as they were, ``after`` as they are now; only changed rows need be given."""
    rows = _signed(before, -1).unionByName(_signed(after, 1))
    _write(rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n != 0"), path, batch)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The cube of all batches: ``KEYS`` and ``n``."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n != 0")


def label_counts(cube: DataFrame) -> DataFrame:
    """Rows per label, most frequent first, from the cube."""
    counts = cube.where("label is not null").groupBy(F.col("label").alias(pf.ARCH)).agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), pf.ARCH)

"""Top labels and distinct labels of a table that comes in batches, where labels are free text.

Each batch leaves a small summary: its ``keep`` most frequent labels with their
counts, the smallest of these counts if there were more labels (no label that
was left out has more rows), and a HyperLogLog sketch of its labels. Summaries
add up in any order. A label left out of every summary has at most the sum of
the batches' cuts. If the k-th count that is certain exceeds that sum, a second
pass over the rows that counts only the labels that may be among the first
``k`` gives the exact top (``proven``); else the second pass counts all labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.session import materialize

KEEP = 1000


def add_batch(df: DataFrame, col: str, path: str, batch: int, keep: int = KEEP) -> None:
    """Summarise the non-null labels of ``df`` as batch number ``batch``; written again, it replaces itself."""
    counts = materialize(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label"))
                         .agg(F.count("*").alias("n")), "label-counts")
    top = materialize(counts.orderBy(F.desc("n"), "label").limit(keep), "label-top")
    whole = counts.agg(F.count("*").alias("n_labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                       F.hll_sketch_agg("label", 14).alias("sketch"))
    cut = F.when(F.col("n_labels") > keep, top.agg(F.min("n")).scalar()).otherwise(0)
    for name, rows in (("tops", top), ("wholes", whole.withColumn("cut", cut))):
        (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(f"{path.rstrip('/')}/{name}"))


def distinct_labels(spark: SparkSession, path: str) -> DataFrame:
    """``n_rows`` and ``n_distinct`` (estimated within about two percent) of all batches."""
    wholes = spark.read.parquet(f"{path.rstrip('/')}/wholes")
    return wholes.agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def top_labels(df: DataFrame, col: str, path: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent labels of ``df`` (the rows of all batches): ``label``, exact ``n``, and ``proven``."""
    spark = df.sparkSession
    error = int(spark.read.parquet(f"{path.rstrip('/')}/wholes").agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0])
    known = spark.read.schema("label string, n bigint, batch int").parquet(f"{path.rstrip('/')}/tops").groupBy("label").agg(F.sum("n").alias("least"))
    known = materialize(known, "label-known")
    # what a label must have for a place among the first k: the k-th of the counts that are certain
    last = [r["least"] for r in known.orderBy(F.desc("least")).limit(k).collect()]
    bar = last[-1] if len(last) == k else 0
    proven = error == 0 or bar > error
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("label"))
    if proven:
        rows = rows.join(known.where(F.col("least") + error >= bar).select("label"), "label", "left_semi")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(k).withColumn("proven", F.lit(proven))

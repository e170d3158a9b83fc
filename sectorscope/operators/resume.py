"""Going on from saved progress: rows that already hold a label are not classified again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_rows(df: DataFrame, saved: DataFrame, key: str, arch_col: str = "Predicted_Archetype") -> DataFrame:
    """Rows of ``df`` whose key has no label in the ``saved`` table; a null key is always pending.

    Only the keys of the saved table cross the shuffle; a missing or empty label counts as not done.
    """
    done = saved.where(F.col(arch_col).isNotNull() & (F.col(arch_col) != "")).select(F.col(key).alias("_done"))
    return df.join(done, df[key] == done["_done"], "left_anti")


def with_saved(result: DataFrame, saved: DataFrame, source: DataFrame, key: str,
               arch_col: str = "Predicted_Archetype") -> DataFrame:
    """``result`` (the rows classified now) and the rows of ``source`` that ``saved`` has a label for.

    The input's columns come from ``source``; the result columns of a saved row from ``saved``, in the types of
    ``result`` (null where it lacks them). Of several saved rows of one key the smallest counts.
    """
    own = [c for c in result.columns if c not in source.columns]
    labelled = saved.where(F.col(arch_col).isNotNull() & (F.col(arch_col) != ""))
    kept = labelled.select(F.col(key).alias("_key"), F.struct(*[
        (F.col(c).cast(result.schema[c].dataType) if c in saved.columns else F.lit(None).cast(result.schema[c].dataType)).alias(c)
        for c in own]).alias("_saved")).groupBy("_key").agg(F.min("_saved").alias("_saved"))
    done = source.join(kept, source[key] == kept["_key"])
    columns = [F.col(f"_saved.`{c}`").alias(c) if c in own else F.col(f"`{c}`") for c in result.columns]
    return result.unionByName(done.select(*columns))

"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the same key. The minima are
written to the shared folder and read back, so both sides of the joins are
ordinary shuffles and AQE splits a node with very many links. Each round's
links are written too, which cuts the lineage; the rounds end when the links
no longer change. Tables of a finished round are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import delete_table, stored


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u``, ``v``) that is not itself the root.

    ``root`` is the smallest node of the component. Self-links and repeated
    links are ignored; an empty table gives an empty result.
    """
    links = (links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links, old = stored(links, label)
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, p1 = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), label)
        large, p2 = stored(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .distinct(), label)
        least, p3 = stored(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = (large.join(least, "u").where("v != m")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        links, new_path = stored(small, label)
        for path in (old, p1, p2, p3):
            delete_table(links.sparkSession, path)
        old = new_path
        new = _state(links)
        if new == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

"""Driver tables and the two derived views used for correctness runs.

``companies`` and ``responses`` are projections of ``customer``: one row per
customer key, so they grow with the data and need no shuffle to build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Our own fixture phrases (test design): index i = P[i].
PHRASES: list[str] = [
    "Cloud software with an analytics API for carriers.",
    "Comparison marketplace run by a licensed broker.",
    "On-demand and parametric cover for the gig economy.",
    "Machine learning and automation for instant claims.",
    "Telematics and IoT monitoring for home safety.",
    "Embedded cover added at checkout through a plugin.",
    "Helps insurers modernize legacy systems.",
    "Platform and portal.",
    "Family insurance services.",
    "Makes garden furniture.",
    "A wellness app.",
    "Rapid capital for patriots.",
]

# A failed call (k % 20 = 14): its message, longer than the 100 characters kept.
FAILED_CALL = ("ConnectionError: the model endpoint closed the connection before it answered; "
               "the client gave up on this request")

# Model responses keyed by k % 10; k % 10 = 4 has no response (k % 20 = 14: a failed call).
RESPONSES: dict[int, str] = {
    0: "not json",
    1: "[1]",
    2: "{}",
    3: '{"archetype":null,"confidence":"Low"}',
    5: ('{"archetype":"Integrators","driving_capabilities":["DC1","DC5"],"innovation_wave":3.0,'
        '"confidence":"High","justification":"short"}'),
    6: ('{"archetype":"Enablers","secondary_archetypes":["Connectors"],"driving_capabilities":["DC2"],'
        '"innovation_wave":"2.0","confidence":"High","justification":"' + "x" * 250 + '"}'),
    7: '{"archetype":"Innovators","secondary_archetypes":"Enablers","innovation_wave":"1.0"}',
    8: ('{"archetype":"Protectors","secondary_archetypes":["Enablers","Disruptors"],'
        '"driving_capabilities":["DC1","DC2","DC3"],"innovation_wave":"3.0","confidence":"Medium",'
        '"justification":"ok"}'),
    9: ('{"archetype":"Disruptors","driving_capabilities":["DC2","DC4"],"innovation_wave":"1.0",'
        '"confidence":"Low","justification":"ok"}'),
}


#: Session setting: spread every table over so many partitions when it is read. Unset by default, and never chosen by
#: size: it is for tables whose files hold one split each (one Parquet row group), as a bench's.
PARTITIONS_CONF = "sectorscope.read.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, spread over ``PARTITIONS_CONF`` partitions if the session sets that."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(partitions)) if partitions else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` before costly work on each row: a compact table is a few splits, whatever its rows.

    The number of partitions is the session's, which AQE merges while they are small and all cores have one; a join or
    group on ``key`` that follows needs no shuffle of its own.
    """
    return df.repartition(F.col(key))


def _phrase(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (idx + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-shaped view over ``customer`` (see FIXTURES.md section 5)."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    desc = (F.when(k % 13 == 0, F.lit(None).cast("string"))
             .when(k % 5 == 0, F.concat(_phrase(k % 12), F.lit(" "), _phrase((k * 7 + 3) % 12)))
             .otherwise(_phrase(k % 12)))
    return c.select(
        k.cast("bigint").alias("company_id"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("Company"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("Industries"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Segment "), F.col("c_nationkey").cast("string"))).alias("industry_groups"),
        desc.alias("Description"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise((F.lit(1995) + k % 30).cast("string")).alias("founded"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model responses keyed by company: one row per customer.

    Customers with ``k % 10 = 4`` have no stored answer (null response and
    token counts): with ``k % 20 = 4`` the call was never made, which
    exercises the keyword fallback; with ``k % 20 = 14`` it failed and
    ``error`` holds the message. ``answered`` keeps the rows with an answer
    or an error.
    """
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    mod = (k % 10).cast("int")
    resp = F.try_element_at(F.create_map(*[x for i, j in sorted(RESPONSES.items())
                                           for x in (F.lit(i), F.lit(j))]), mod)
    has = resp.isNotNull()
    return c.select(k.cast("bigint").alias("company_id"),
                    resp.alias("response_json"),
                    F.when(k % 20 == 14, F.lit(FAILED_CALL)).alias("error"),
                    F.when(has, (F.lit(400) + k % 100).cast("bigint")).alias("input_tokens"),
                    F.when(has, (F.lit(100) + k % 50).cast("bigint")).alias("output_tokens"))


# Column mapping used by every query over the ``companies`` view.
COMPANY_DESC = "Description"
COMPANY_AUX = ["Industries", "industry_groups", "Full Description", "Description"]


def raw_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``companies`` as a CSV export would spell it: each null cell holds a null token.

    The token is chosen by the key, so every token of the list occurs.
    """
    from sectorscope.sources.files import NULL_TOKENS
    c = companies(spark, sf_dir)
    k = F.col("company_id")
    token = F.element_at(F.array(*[F.lit(t) for t in NULL_TOKENS]), (k % len(NULL_TOKENS) + 1).cast("int"))
    return c.select("company_id", *[F.coalesce(F.col(n), token).alias(n)
                                    for n in c.columns if n != "company_id"])

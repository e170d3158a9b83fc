"""Costly work on each row is dealt over the cluster and done once."""

import pytest
from pyspark.sql import functions as F

from sectorscope.operators import profiles
from sectorscope.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def counted(spark):
    """A column function that passes a value on and counts how many were asked for."""
    seen = spark.sparkContext.accumulator(0)

    def column(value):
        def one(x):
            seen.add(1)
            return x
        return F.udf(one, "string").asNondeterministic()(value)
    return seen, column


def test_companies_are_dealt_before_they_are_classified(spark):
    for df in (catalog._classified(spark, SF), catalog._model_results(spark, SF)):
        assert "REPARTITION_BY_COL" in df._jdf.queryExecution().toString()


def test_live_cube_takes_each_result_once(spark, counted, monkeypatch):
    seen, column = counted
    results = catalog._model_results
    rows = results(spark, SF).count()
    monkeypatch.setattr(catalog, "_model_results", lambda *a: results(*a).withColumn("Confidence_Score", column("Confidence_Score"))
                        .withColumn("Predicted_Archetype", F.coalesce(column("Predicted_Archetype"), "Confidence_Score")))
    assert catalog.q_label_counts_live(spark, SF).count() > 0
    assert seen.value <= 2 * rows


def test_running_sum_takes_each_row_once(spark, counted):
    seen, column = counted
    df = spark.range(0, 1000, 1, 4).withColumn("v", column(F.lit("2")))
    out = profiles.running_sum(df, "id", F.col("v").cast("bigint"), "total", keep=["v"])
    assert out.where(F.col("total") == 2 * (F.col("id") + 1)).count() == 1000
    assert seen.value == 1000

from pyspark.sql import functions as F

from sectorscope.operators.classify import classify_companies
from sectorscope.sources.tables import COMPANY_AUX, companies
from sectorscope.streaming import incremental
from conftest import SF_SMALL

KEEP = ["company_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found"]


def test_two_runs_equal_one_batch_and_rerun_adds_nothing(spark, scratch):
    c = companies(spark, SF_SMALL)
    src, sink, ckpt = scratch("in"), scratch("out"), scratch("ckpt")
    first, second = c.filter(F.col("company_id") % 2 == 0), c.filter(F.col("company_id") % 2 == 1)
    first.repartition(2).write.parquet(f"{src}/a")
    run = lambda: incremental.classify_stream(spark, f"{src}/*", c.schema, sink, ckpt, "Description",
                                              COMPANY_AUX, keep=KEEP).awaitTermination()
    run()
    assert spark.read.parquet(sink).count() == first.count()
    second.repartition(2).write.parquet(f"{src}/b")
    run()
    run()
    streamed = sorted(map(tuple, spark.read.parquet(sink).select(KEEP).collect()))
    batch = sorted(map(tuple, classify_companies(c, "Description", COMPANY_AUX).select(KEEP).collect()))
    assert streamed == batch


def test_progress_table(spark, scratch):
    c = companies(spark, SF_SMALL)
    src = scratch("in")
    c.repartition(3).write.parquet(src)
    q = incremental.classify_stream_with_progress(spark, src, c.schema, scratch("out"), m := scratch("metrics"),
                                                  scratch("ckpt"), "Description", COMPANY_AUX,
                                                  max_files_per_trigger=1)
    q.awaitTermination()
    p = incremental.progress_table(spark, m, total_rows=c.count()).orderBy("batch_id").collect()
    assert len(p) == 3 and p[-1]["rows_done"] == c.count()
    assert p[-1]["pct_done"] == 100.0 and p[-1]["eta_s"] == 0.0 and p[-1]["eta_text"] == "0s"


def test_duration_text(spark):
    df = spark.createDataFrame([(42.7,), (185.0,), (7625.0,)], "s double")
    got = [r[0] for r in df.select(incremental.duration_text(F.col("s"))).collect()]
    assert got == ["42s", "3m 5s", "2h 7m"]

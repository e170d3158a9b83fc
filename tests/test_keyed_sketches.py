"""One row a company from a stream, and summaries of free-text labels."""

from pyspark.sql import functions as F

from sectorscope.operators import label_sketches
from sectorscope.streaming import keyed

SCHEMA = "company_id int, version long, seen timestamp, note string"


def _stream(spark, scratch, waves, last, delay):
    src, sink, ckpt = scratch("in"), scratch("kept"), scratch("ckpt")
    for rows in waves:
        df = spark.createDataFrame(rows, "company_id int, version long, seen string, note string").withColumn("seen", F.to_timestamp("seen"))
        df.repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        keyed.write_kept(keyed.keep_one(stream, "company_id", "version", "seen", delay, last), sink, ckpt).awaitTermination()
    return sorted((r["company_id"], r["version"], r["note"]) for r in keyed.latest(spark, sink, stream.schema).collect())


def test_first_and_last_version(spark, scratch):
    waves = [[(1, 5, "2024-01-01", "e"), (1, 5, "2024-01-01", "d"), (2, 1, "2024-01-02", "a"), (None, 1, "2024-01-01", "x")],
             [(1, 3, "2024-01-01", "late"), (2, 9, "2024-01-03", "z"), (3, None, "2024-01-03", "x"), (4, 1, None, "x")]]
    assert _stream(spark, scratch, waves, False, "30 days") == [(1, 3, "late"), (2, 1, "a")]
    assert _stream(spark, scratch, waves, True, "30 days") == [(1, 5, "d"), (2, 9, "z")]


def test_state_goes_behind_the_watermark(spark, scratch):
    # company 1 comes back long after its state went: it counts as new, with its later version
    waves = [[(1, 1, "2024-01-01", "a")], [(2, 1, "2024-03-01", "b")], [(3, 1, "2024-06-01", "c")], [(1, 7, "2024-06-02", "again")]]
    assert _stream(spark, scratch, waves, False, "1 day") == [(1, 7, "again"), (2, 1, "b"), (3, 1, "c")]


def test_label_sketches(spark, scratch):
    rows = [(f"label {i}",) for i in range(300) for _ in range(1 + 400 // (i + 1))] + [(None,)] * 50
    df = spark.createDataFrame(rows, "label string").withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(3)))
    want = [tuple(r) for r in df.where("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(10).collect()]
    for keep, proven in ((1000, True), (40, True), (3, False)):
        path = scratch("sketches")
        for batch in (0, 1, 2, 1):  # batch 1 twice
            label_sketches.add_batch(df.where(F.col("b") == batch), "label", path, batch, keep)
        top = label_sketches.top_labels(df, "label", path, 10).collect()
        assert [(r["label"], r["n"]) for r in top] == want and {r["proven"] for r in top} == {proven}
        whole = label_sketches.distinct_labels(spark, path).first()
        assert whole["n_rows"] == len(rows) - 50 and abs(whole["n_distinct"] - 300) <= 6
    path = scratch("sketches")
    label_sketches.add_batch(df.limit(0), "label", path, 0)
    assert label_sketches.top_labels(df.limit(0), "label", path).count() == 0

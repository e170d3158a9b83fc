"""The keyed stream's state table."""

from pyspark.sql import functions as F

from sectorscope.streaming import keyed


def test_no_python_call_a_key_and_a_batch_again(spark, scratch):
    states = scratch("states")
    df = spark.createDataFrame([(i % 50, i, "2024-01-01") for i in range(200)], "k int, v long, at string").withColumn("at", F.to_timestamp("at"))
    kept = keyed.keep_one(df, "k", "v", "at", "1 day", last=True)
    first = keyed._advance(kept.rows.where("key < 40 and order < 100"), 0, kept, states)
    assert "Pandas" not in first._jdf.queryExecution().toString() and first.count() == 40
    for _ in range(2):  # a batch that is run again starts from its predecessor's table
        again = {r["key"]: r["order"] for r in keyed._advance(kept.rows, 1, kept, states).collect()}
        assert again == {k: 150 + k for k in range(50)}
    assert keyed._advance(kept.rows, 2, kept, states).count() == 0
    assert keyed._advance(kept.rows.where("false"), 3, kept, states).count() == 0
    # one row a key stays, and no table older than the predecessor's
    assert spark.read.parquet(f"{states}/3").count() == 50
    assert not keyed._folder(spark, states)[0].exists(keyed._folder(spark, f"{states}/1")[1])


def test_late_rows_do_not_count(spark, scratch):
    states = scratch("states")
    df = spark.createDataFrame([(1, 5, "2024-03-01"), (2, 4, "2024-01-01"), (1, 1, "2024-02-28"), (3, 1, "2024-02-29")], "k int, v long, at string") \
        .withColumn("at", F.to_timestamp("at"))
    kept = keyed.keep_one(df, "k", "v", "at", "2 days")
    assert keyed._advance(kept.rows.where("order > 3"), 0, kept, states).count() == 2
    assert [(r["key"], r["order"]) for r in keyed._advance(kept.rows.where("order < 3"), 1, kept, states).collect()] == [(3, 1)]


def test_a_key_that_a_batch_has_not_stays(spark, scratch):
    states = scratch("states")
    df = spark.createDataFrame([(1, 0, "2024-01-01"), (2, 1, "2024-01-02"), (1, 2, "2024-01-03")], "k int, v long, at string") \
        .withColumn("at", F.to_timestamp("at"))
    kept = keyed.keep_one(df, "k", "v", "at", "30 days")
    for batch in range(3):
        changed = keyed._advance(kept.rows.where(F.col("order") == batch), batch, kept, states)
        assert [r["order"] for r in changed.collect()] == ([batch] if batch < 2 else [])
    assert {r["key"]: r["held"]["order"] for r in spark.read.parquet(f"{states}/2").collect()} == {1: 0, 2: 1}

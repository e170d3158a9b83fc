"""How the answer log deals prompts: by their true size, equal ones once, nothing sorted on the way in."""

from pyspark.sql import functions as F

from sectorscope.operators import answer_log


def test_tasks_hold_a_bounded_size_of_prompts(spark, scratch, monkeypatch):
    monkeypatch.setattr(answer_log, "TASK_BYTES", 100_000, raising=False)
    alike = "the same long framework text " * 100
    requests = spark.range(0, 900, 1, 1).select(F.concat(F.lit(alike), (F.col("id") % 800).cast("string")).alias("prompt"))
    files = scratch("seen")

    def model(pdf):
        return pdf[["request"]].assign(response_json=pdf["prompt"].str.slice(-3))
    monkeypatch.setattr(answer_log, "scratch_path", lambda s, label: f"{files}-{label}")
    done = answer_log.ask(requests, model, scratch("log"), "one", parts=1, batch_rows=100)
    assert done.count() == 800 and done.select("request").distinct().count() == 800
    # some 2.6 MB of prompts that compress to almost nothing: still a task for each 100 KB of them
    per_file = spark.read.parquet(f"{files}-pending-requests").groupBy(F.input_file_name()).agg(F.sum(F.length("prompt")).alias("n"))
    assert per_file.count() > 15 and per_file.agg(F.max("n")).first()[0] < 300_000

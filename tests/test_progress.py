"""Answer log, resume at the command line, the live cube, and lexicon tables with odd rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sectorscope import cli
from sectorscope.operators import answer_log, live_cube, profiles
from sectorscope.operators.findings import findings, findings_of_cube
from sectorscope.operators.lexicon_join import classify_by_join
from tests.test_cli import _write_input


def test_answer_log_goes_on_after_a_failure(spark, scratch):
    log, calls = scratch("log"), scratch("calls")
    prompts = [f"prompt {i % 40}" for i in range(60)] + [None]
    requests = spark.createDataFrame([(p,) for p in prompts], "prompt string").repartition(3)

    def model(fail):
        def fn(pdf):
            if fail and any(int(r[:4], 16) % 4 == 2 for r in pdf["request"]):
                raise RuntimeError("away")
            return pd.DataFrame({"request": pdf["request"], "response_json": "{" + pdf["prompt"] + "}"})
        return fn

    with pytest.raises(Exception, match="away"):
        answer_log.ask(requests, model(True), log, "one", parts=4)
    first = answer_log.read_log(spark, log).collect()
    assert first and {int(r["request"][:4], 16) % 4 for r in first} == {0, 1}
    done = answer_log.ask(requests, model(False), log, "two", parts=4).collect()
    assert len(done) == 40 and len({r["request"] for r in done}) == 40
    assert {r["run"] for r in done if int(r["request"][:4], 16) % 4 < 2} == {"one"}
    assert {r["run"] for r in done if int(r["request"][:4], 16) % 4 >= 2} == {"two"}

    def never(pdf):
        raise RuntimeError("nothing is left to ask")
    assert answer_log.ask(requests, never, log, "three", parts=4).count() == 40
    assert answer_log.ask(requests.limit(0), never, calls, "x").count() == 0
    # a part without its marker does not count
    spark.createDataFrame([("r", "{}", None, "lost")], answer_log.SCHEMA).write.parquet(f"{log}/parts/lost-0")
    assert answer_log.read_log(spark, log).where("run = 'lost'").count() == 0


def test_cli_resume_and_lexicon(spark, scratch):
    src, out, saved = scratch("cli-in") + ".csv", scratch("cli-out"), scratch("saved") + ".parquet"
    _write_input(src)
    spark.createDataFrame([("1", "Kept Label", "Low"), ("3", "", "Low"), ("9", "Gone", "Low")],
                          "company_id string, Predicted_Archetype string, Confidence_Score string").write.parquet(saved)
    path = cli.main([src, "--out", out, "--resume", saved, "--run-id", "r1"], spark=spark)
    got = {r["company_id"]: r for r in spark.read.parquet(path).collect()}
    assert {k: r["Predicted_Archetype"] for k, r in got.items()} == {"1": "Kept Label", "2": "Disruptors", "3": "Unclassified"}
    assert got["1"]["Company"] == "TechInsure" and got["1"]["Keywords_Found"] is None
    # the written run is itself a saved result: nothing is left but the row without a label
    again = cli.main([src, "--out", out, "--resume", path, "--run-id", "r2"], spark=spark)
    assert {r["Predicted_Archetype"] for r in spark.read.parquet(again).collect()} == {"Kept Label", "Disruptors", "Unclassified"}
    lexicon = scratch("lexicon") + ".csv"
    spark.createDataFrame([(1, "Gardens", 1, "garden")], "cat_ord int, category string, kw_ord int, keyword string") \
        .write.option("header", True).csv(lexicon)
    path = cli.main([src, "--out", out, "--lexicon", lexicon, "--infer-types", "--run-id", "r3"], spark=spark)
    rows = spark.read.parquet(path)
    assert dict(rows.dtypes)["company_id"] == "bigint"
    assert {r["company_id"]: r["Predicted_Archetype"] for r in rows.collect()}[3] == "Gardens"
    with pytest.raises(SystemExit, match="is not a column"):
        cli.main([src, "--out", out, "--resume", saved, "--key", "nope"], spark=spark)


def test_live_cube(spark, scratch):
    cols = "id int, Predicted_Archetype string, Innovation_Wave string, Secondary_Archetypes string, Driving_Capabilities string"
    rows = [(i, ["A", "B", None, "API Error"][i % 4], ["1.0", "3.0", ""][i % 3], ["", "x"][i % 2], ["DC1, DC3", "DC2", None][i % 3])
            for i in range(50)]
    df, path = spark.createDataFrame(rows, cols), scratch("cube")
    for k in range(3):
        live_cube.add_batch(df.where(F.col("id") % 3 == k), path, k)
    live_cube.add_batch(df.where("id % 3 = 1"), path, 1)  # a batch that is written again replaces itself
    after = df.withColumn("Predicted_Archetype", F.when(F.col("id") < 9, "C").otherwise(F.col("Predicted_Archetype")))
    live_cube.correct(df.where("id < 9"), after.where("id < 9"), path, 3)
    cube = live_cube.current(spark, path)
    assert sorted(map(str, findings_of_cube(cube, profiles.DC_CODES).collect())) == sorted(map(str, findings(after).collect()))
    assert [tuple(r) for r in live_cube.label_counts(cube).collect()] == [tuple(r) for r in profiles.archetype_counts_all(after).collect()]
    assert cube.where("n < 0").count() == 0


def test_lexicon_table_with_odd_rows(spark):
    rows = [(5, "five", 2, "Cloud"), (5, "five", 9, "cloud"), (1, "one", None, "data"), (1, "one", 1, "a\u0000b"), (1, "one", 3, ""),
            (5, "five", 4, None), (None, "none", 1, "sky"), (7, None, 1, "sky"), (9, "nine", 1, "aa"), (9, "nine", 0, "日本")]
    table = spark.createDataFrame(rows, "cat_ord int, category string, kw_ord int, keyword string")
    texts = spark.createDataFrame([(1, "cloud CLOUD data"), (2, "aaaaa 日本日本"), (3, None), (4, "sky"), (5, "x" * 5000 + "cloud" + "y" * 5000),
                                   (1, "data")], "id int, text string")
    got = sorted((r["id"], r["scores"], r["found"], r["Predicted_Archetype"])
                 for r in classify_by_join(texts, "id", "text", lex_df=table, keep_scores=True).collect())
    assert got == [(1, [1, 0, 0], [["data"], [], []], "one"), (1, [1, 2, 0], [["data"], ["Cloud"], []], "five"),
                   (2, [0, 0, 4], [[], [], ["日本", "aa"]], "nine"), (3, [0, 0, 0], [[], [], []], "Unclassified"),
                   (4, [0, 0, 0], [[], [], []], "Unclassified"), (5, [0, 1, 0], [[], ["Cloud"], []], "five")]
    for bad in ([(1, "a", 1, "x"), (1, "b", 1, "y")], [(1, "a", 1, "x"), (2, "a", 1, "y")]):
        with pytest.raises(ValueError):
            classify_by_join(texts, "id", "text", lex_df=spark.createDataFrame(bad, table.schema))
    assert classify_by_join(texts, "id", "text", lex_df=table.limit(0)).count() == 6


def test_few_positions_become_rows(spark):
    from sectorscope.operators import lexicon_join as lj
    from sectorscope.plans.catalog import word_lexicon
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    table = lj.materialize(word_lexicon(docs), "lexicon")
    assert table.count() > 5000
    texts = lj.keyed_texts(docs, "doc_id", "text")
    anchors = lj._anchors(texts, lj._keywords(table, lj.table_lexicon(table)))
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    assert lj.candidates(texts, anchors).where("pos >= 0").count() < chars / 10

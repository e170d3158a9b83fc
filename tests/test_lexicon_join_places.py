"""Positions of the join scorer: found as arrays, in blocks of bounded size, whatever the texts."""

import random

from pyspark.sql import functions as F

from sectorscope.operators import lexicon_join as lj

WORDS = ["ab", "abab", "cloud", "日本", "é", "platform", "𝄞music", "x", "insurtech platform"]


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lj, "BLOCK", 64)
    rng = random.Random(5)
    texts = [None, "", " ", "abababab", "\u0000cloud\u0000"] + ["".join(rng.choice([*WORDS, " ", "a", "b", "insurtech "]) for _ in range(n))
                                                                for n in (1, 5, 20, 60, 200) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame([(i + 1, f"c{i}", 1, w) for i, w in enumerate(WORDS)], "cat_ord int, category string, kw_ord int, keyword string")
    got = {r["id"]: list(r["scores"]) for r in lj.score_by_join(df, "id", "text", lex_df=table).select("id", "scores").collect()}
    assert got == {i: [(t or "").count(w) for w in WORDS] for i, t in enumerate(texts)}


def test_no_row_function_over_every_position(spark):
    df = spark.createDataFrame([(1, "cloud platform")], "id int, text string")
    table = spark.createDataFrame([(1, "a", 1, "cloud"), (2, "b", 1, "platform")], "cat_ord int, category string, kw_ord int, keyword string")
    texts = lj.keyed_texts(df, "id", "text")
    rows = lj.candidates(texts, lj._anchors(texts, lj._keywords(table, lj.table_lexicon(table))))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().toString()
    assert rows.where("pos >= 0").count() == 2 and rows.where((F.col("pos") < 0) & (F.col("gram") % 2 != 0)).count() == 1

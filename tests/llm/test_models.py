"""Trained operators: held-out accuracy, and rows they must not trip over."""

from pyspark.sql import functions as F

from sectorscope.llm import langid, quality_mil
from sectorscope.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.where(~held).where("lang is not null"))
    got = langid.predict(docs.where(held), model, carry=("doc_id", "lang", "text"))
    right = got.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"),
                    F.max("score").alias("hi")).first()
    assert right["a"] > 0.97 and 0 <= right["lo"] <= right["hi"] <= 1
    assert got.where("accepted and lang_pred != row.lang").count() <= 0.02 * got.count()


def test_prediction_is_a_plain_sum_over_subwords(spark, documents, odd):
    import numpy as np
    cfg = langid.LangIdConfig()
    model = langid.train(documents.where("lang is not null"))
    for df in (documents.where("length(text) < 5000"), odd.where("doc_id < 8")):
        for r in langid.predict(df, model, carry=("text",)).collect():
            total, n = np.zeros(len(model.languages)), 0
            word = ""
            for c in (r["row"]["text"] or "").lower() + " ":
                if c.isalpha():
                    word += c
                elif word:
                    marked = f"<{word}>"
                    for k in range(cfg.min_gram, cfg.max_gram + 1):
                        for i in range(len(marked) - k + 1):
                            h = k
                            for x in marked[i:i + k]:
                                h = (h ^ ord(x)) * 0x9E3779B97F4A7C15 % 2 ** 64
                                h ^= h >> 29
                            total += model.table[h % cfg.buckets]
                            n += 1
                    word = ""
            if not n:
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
                continue
            z = (total / n + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert abs(r["score"] - p.max()) < 1e-6 and model.languages[int(p.argmax())] == r["lang_pred"]


def test_every_language_is_learned(spark):
    # more languages than rows allowed for the sample, one of them with most rows under one id and text
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} word", f"l{i:03d}") for i in range(300)] * 3
    rows += [(7, "the same text again", "l007")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = langid.LangIdConfig(sample_rows=100, per_language=50)
    sample = langid.sample_labelled(df, "text", "lang", "doc_id", cfg).collect()
    assert sorted(r["lang"] for r in sample) == [f"l{i:03d}" for i in range(300)]
    cfg = langid.LangIdConfig(sample_rows=10 ** 6, per_language=50)
    sample = langid.sample_labelled(df, "text", "lang", "doc_id", cfg).collect()
    assert sum(r["lang"] == "l007" for r in sample) == 50 and len(sample) == 50 + 299 * 3


def test_language_id_odd_rows(spark, odd, empty):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de")
                                   for i in range(60)], "doc_id long, text string, lang string")
    model = langid.train(train)
    numerals = spark.createDataFrame([(90, "\u00bd \u00b2"), (91, "\u2460\u2461"), (92, "\u2167 12 _")], "doc_id long, text string")
    odd = odd.select("doc_id", "text").unionByName(numerals)
    got = langid.predict(odd, model, carry=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("und", "en", "de") and 0 <= r["score"] <= 1
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(train, nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 5) == 0
    model = quality_mil.train(docs, labels.where(~held))
    rows = (quality_mil.score(docs, model).select("row.doc_id", "score").join(labels, "doc_id").where(held)
            .select("score", "quality").collect())
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(g >= 0.3 for g in good) > 0.95 * len(good)


def test_attention_finds_the_bad_passage():
    import numpy as np
    rng = np.random.default_rng(0)
    width = quality_mil.MilConfig().shapes + quality_mil._STYLE + 3
    bags, labels = [], []
    for k in range(200):
        bag = rng.normal(0, 0.1, (6, width)).astype(np.float32)
        if k % 2:
            bag[k % 6, 3] += 4
        bags.append(bag)
        labels.append(1 - k % 2)
    model = quality_mil.fit(bags, np.array(labels, float))
    scores, attention = model.score(bags)
    assert ((scores > 0.5) == (np.array(labels) == 1)).mean() > 0.95
    assert all(abs(a.sum() - 1) < 1e-6 for a in attention)


def test_score_against_a_loop_over_passages(documents):
    import math

    import numpy as np
    rng = np.random.default_rng(5)
    cfg = quality_mil.MilConfig()
    width = cfg.shapes + quality_mil._STYLE + 3
    w = {"mean": rng.normal(0, 1, width), "scale": rng.uniform(1, 2, width), "V": rng.normal(0, 0.1, (width, cfg.hidden)),
         "v0": rng.normal(0, 1, cfg.hidden), "A": rng.normal(0, 1, (cfg.hidden, cfg.attention)),
         "G": rng.normal(0, 1, (cfg.hidden, cfg.attention)), "w": rng.normal(0, 1, cfg.attention),
         "c": rng.normal(0, 1, cfg.hidden), "c0": rng.normal(0, 1, 1)}
    model = quality_mil.MilModel(w, True)
    for r in quality_mil.score(documents, model, carry=("text",)).limit(60).collect():
        bag = quality_mil.encode_passages((r["row"]["text"] or "").encode(), quality_mil.Shapes(cfg))
        assert r["n_passages"] == len(bag) == max(1, -(-len((r["row"]["text"] or "").encode().split()) // cfg.passage_words))
        hidden, raw = [], []
        for row in bag:
            h = [math.tanh(sum(((row[i] - w["mean"][i]) / w["scale"][i]) * w["V"][i, k] for i in range(width)) + w["v0"][k])
                 for k in range(cfg.hidden)]
            gate = [math.tanh(sum(h[k] * w["A"][k, a] for k in range(cfg.hidden)))
                    / (1 + math.exp(-sum(h[k] * w["G"][k, a] for k in range(cfg.hidden)))) for a in range(cfg.attention)]
            hidden.append(h)
            raw.append(sum(g * x for g, x in zip(gate, w["w"])))
        total = sum(map(math.exp, raw))
        z = w["c0"][0] + sum(math.exp(e) / total * sum(x * c for x, c in zip(h, w["c"])) for e, h in zip(raw, hidden))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-4
        assert abs(r["top_weight"] - max(map(math.exp, raw)) / total) < 1e-4


def test_the_fit_sees_every_passage(spark):
    # one bad passage among 300 decides the label; the good documents are alike but for it
    good = " ".join("plain words in a row that say some more" for _ in range(8)).split()[:64]
    bad = [f"#{i}$!!" for i in range(64)]
    docs = [(k, " ".join(x for p in range(300) for x in (bad if k % 2 and p == 7 * k % 300 else good))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_mil.train(df, labels)
    got = {r["row"]["doc_id"]: r for r in quality_mil.score(df, model).collect()}
    assert all((got[k]["score"] > 0.5) == (k % 2 == 0) for k in range(60))
    assert min(got[k]["top_weight"] for k in range(1, 60, 2)) > 5 / 300


def test_long_words_are_encoded_whole():
    cfg = quality_mil.MilConfig()
    blob = b"ab" * 5000
    assert b"".join(quality_mil.words_of(blob, cfg.piece)) == blob
    one, two = (quality_mil.encode_passages(x, quality_mil.Shapes(cfg)) for x in (blob, blob[:9000] + b"#;" * 500))
    assert one.shape == two.shape and (one != two).any()


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (4, 1), (10, 0), (None, 1), (6, None), (7, 0)], "doc_id long, quality int")
    model = quality_mil.train(odd, labels)
    got = quality_mil.score(odd, model, carry=("doc_id", "text")).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["row"]["text"] or "").strip()}) == 1
    assert quality_mil.score(empty, model).count() == 0
    unlearned = quality_mil.train(odd, labels.limit(0))
    assert {r["score"] for r in quality_mil.score(odd, unlearned).collect()} == {0.5}

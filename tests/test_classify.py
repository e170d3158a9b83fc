import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sectorscope.functions.lexicon import Lexicon, default_lexicon, probe_lexicon
from sectorscope.operators.classify import classify_companies, classify_text, score
from sectorscope.operators.lexicon_join import classify_by_join
from sectorscope.plans.explain import plan_text
from sectorscope.sources.tables import read_table
from conftest import SF_SMALL

# The reference's nine-company fixture and the results its rules give.
FIXTURE = [
    ("TechInsure", "We provide a SaaS platform for insurers to digitize operations."),
    ("MarketPlaceX", "A leading comparison marketplace for car insurance."),
    ("P2PProtect", "Peer-to-peer coverage for the gig economy."),
    ("AutoClaimAI", "AI-driven underwriting and instant claims automation."),
    ("SafeHomeIoT", "IoT devices for home safety and prevention."),
    ("EmbedCover", "API-first embedded insurance for e-commerce."),
    ("LegacyHelp", "Consulting for digital transformation of legacy systems."),
    ("UnknownCorp", "Just a graphic design agency."),
    ("HybridCorp", "We offer a SaaS platform and also run a comparison marketplace."),
]
GOLDEN = {
    "TechInsure": ([3, 0, 0, 0, 0, 0, 0], "Enablers", "High", "platform, saas, digitize"),
    "MarketPlaceX": ([0, 2, 0, 0, 0, 0, 0], "Connectors", "Medium", "marketplace, comparison"),
    "P2PProtect": ([0, 0, 2, 0, 0, 0, 0], "Innovators", "Medium", "peer-to-peer, gig economy"),
    "AutoClaimAI": ([0, 0, 0, 3, 0, 0, 0], "Disruptors", "High", "automation, ai-driven, instant"),
    "SafeHomeIoT": ([0, 0, 0, 0, 3, 0, 0], "Protectors", "High", "prevention, iot, safety"),
    "EmbedCover": ([1, 0, 0, 0, 0, 2, 0], "Integrators", "Medium", "embedded, api-first"),
    "LegacyHelp": ([0, 0, 0, 0, 0, 0, 2], "Transformers", "Medium", "digital transformation, legacy systems"),
    "UnknownCorp": ([0, 1, 0, 0, 0, 0, 0], "Connectors", "Medium", "agency"),
    "HybridCorp": ([2, 2, 0, 0, 0, 0, 0], "Hybrid", "Medium", "platform, saas, marketplace, comparison"),
}


@pytest.mark.parametrize("scorer", ["native", "arrow", "aho"])
def test_golden_fixture(spark, scorer):
    df = spark.createDataFrame(FIXTURE, "Company string, Description string")
    out = classify_companies(df, "Description", scorer=scorer)
    got = {r["Company"]: r for r in out.collect()}
    for name, (_, arch, conf, kws) in GOLDEN.items():
        r = got[name]
        assert (r["Predicted_Archetype"], r["Confidence_Score"], r["Keywords_Found"]) == (arch, conf, kws), name
        assert (r["Secondary_Archetypes"], r["Driving_Capabilities"], r["Innovation_Wave"]) == ("", "", "")
    scores = {r["Company"]: r["scores"] for r in
              classify_text(df, "Description", keep_scores=True, scorer=scorer).collect()}
    assert {k: v[0] for k, v in GOLDEN.items()} == scores


def test_fallbacks_and_nulls(spark):
    rows = [("a", None), ("b", ""), ("c", "Family insurance services ltd."), ("d", "Makes garden furniture."),
            ("e", "PATRIOT capital")]
    out = classify_text(spark.createDataFrame(rows, "id string, text string"), "text")
    got = {r["id"]: (r["Predicted_Archetype"], r["Confidence_Score"], r["Keywords_Found"]) for r in out.collect()}
    assert got["a"] == ("Unclassified", "Low", "")
    assert got["b"] == ("Unclassified", "Low", "")
    assert got["c"] == ("Traditional / Generalist", "Low", "insurance, services, ltd")
    assert got["d"] == ("Unclassified", "Low", "")
    # substring semantics: "iot" inside "patriot", "api" inside "capital"
    assert got["e"] == ("Hybrid", "Medium", "api, iot")


def test_word_guard_only_for_non_word_keywords(spark):
    lex = Lexicon.of([("dash", ["--"]), ("x", ["x"])])
    assert lex.needs_word_guard and not default_lexicon().needs_word_guard
    df = spark.createDataFrame([("1", "-- --"), ("2", "a -- b")], "id string, text string")
    got = {r["id"]: r["Predicted_Archetype"] for r in classify_text(df, "text", lex).collect()}
    assert got == {"1": "Unclassified", "2": "dash"}
    joined = {r["id"]: r["Predicted_Archetype"] for r in classify_by_join(df, "id", "text", lex).collect()}
    assert joined == got


def test_case_sensitive_lexicon_reports_original_spelling(spark):
    lex = Lexicon.of([("Cloud", ["SaaS", "Cloud"]), ("Other", ["zzz"])])
    df = spark.createDataFrame([("1", "saas and CLOUD and cloud")], "id string, text string")
    r = classify_text(df, "text", lex, keep_scores=True).first()
    assert r["scores"] == [3, 0] and r["Keywords_Found"] == "SaaS, Cloud" and r["Confidence_Score"] == "High"


def test_scorers_agree_on_documents(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    for lex in (default_lexicon(), probe_lexicon()):
        native = classify_text(d, "text", lex, keep_scores=True)
        arrow = classify_text(d, "text", lex, scorer="arrow", keep_scores=True)
        aho = classify_text(d, "text", lex, scorer="aho", keep_scores=True)
        joined = classify_by_join(d, "doc_id", "text", lex, keep_scores=True)
        cols = ["doc_id", "scores", "found", "Predicted_Archetype", "Confidence_Score", "Keywords_Found"]
        a = sorted(map(tuple, native.select(cols).collect()))
        assert a == sorted(map(tuple, arrow.select(cols).collect()))
        assert a == sorted(map(tuple, aho.select(cols).collect()))
        assert a == sorted(map(tuple, joined.select(cols).collect()))


def test_join_scorer_self_overlapping_keywords(spark):
    lex = Lexicon.of([("a", ["aa", "abab"]), ("b", ["b"])])
    rows = [(1, "aaaaa"), (2, "abababab"), (3, "xyz"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    lit = {r["id"]: r["scores"] for r in score(df, "text", lex).collect()}
    joined = {r["id"]: r["scores"] for r in classify_by_join(df, "id", "text", lex, keep_scores=True).collect()}
    assert lit == joined
    assert lit[1] == [2, 0] and lit[2] == [2, 4]


def test_join_scorer_shuffled_path(spark):
    # beyond Spark's broadcast bound the keyword table is shuffled: same results
    d = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    lex = probe_lexicon()
    cols = ["doc_id", "scores", "found", "Predicted_Archetype", "Confidence_Score", "Keywords_Found"]
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = classify_by_join(d, "doc_id", "text", lex, keep_scores=True)
        rows = sorted(map(tuple, joined.select(cols).collect()))
        plan = plan_text(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "BroadcastHashJoin" not in plan
    native = classify_text(d, "text", lex, scorer="native", keep_scores=True)
    assert rows == sorted(map(tuple, native.select(cols).collect()))


TEXTS = st.text(alphabet=st.sampled_from(list("abcdeiotplsf -")), max_size=60)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_properties(spark, texts):
    lex = Lexicon.of([("c1", ["api", "iot", "sa"]), ("c2", ["pl", "ai"]), ("c3", ["e"])])
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = classify_text(df, "text", lex, keep_scores=True)
    got = {r["id"]: r for r in out.collect()}
    # the JVM scorer agrees row for row
    native = {r["id"]: r for r in classify_text(df, "text", lex, scorer="native", keep_scores=True).collect()}
    assert native == got
    for i, t in enumerate(texts):
        low, up = got[i], got[100 + i]
        # case does not change scores or labels
        assert low["scores"] == up["scores"] and low["Predicted_Archetype"] == up["Predicted_Archetype"]
        # scores are non-overlapping substring counts
        assert low["scores"] == [sum(t.lower().count(k) for k in ks) for ks in lex.match_keywords]
        best = max(low["scores"])
        assert (low["Predicted_Archetype"] == "Hybrid") == (best > 0 and low["scores"].count(best) > 1)
    # adding a keyword never lowers its category's score
    more = Lexicon.of([("c1", ["api", "iot", "sa", "d"]), ("c2", ["pl", "ai"]), ("c3", ["e"])])
    out2 = score(spark.createDataFrame(rows, "id long, text string"), "text", more)
    for r in out2.collect():
        assert r["scores"][0] >= got[r["id"]]["scores"][0]


def test_classifier_plan_is_one_projection(spark):
    d = read_table(spark, SF_SMALL, "documents")
    plan = plan_text(classify_text(d, "text", scorer="native"))
    assert "Exchange" not in plan and "Python" not in plan
    # the automaton scorer adds one Arrow-batched Python step, still no shuffle
    plan = plan_text(classify_text(d, "text", scorer="aho"))
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_aho_scorer_edge_cases(spark):
    lex = Lexicon.of([("a", ["aa", "abab", "api"]), ("b", ["b", "api-first"]), ("dash", ["--"])], ["inc", "ltd"])
    rows = [(1, "aaaaa"), (2, "abababab"), (3, "xyz inc"), (4, None), (5, "API-first Api"), (6, "-- --"), (7, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    cols = ["id", "scores", "found", "Predicted_Archetype", "Confidence_Score", "Keywords_Found"]
    native = sorted(map(tuple, classify_text(df, "text", lex, scorer="native", keep_scores=True).select(cols).collect()))
    aho = sorted(map(tuple, classify_text(df, "text", lex, scorer="aho", keep_scores=True).select(cols).collect()))
    assert native == aho
    assert aho[0][1] == [2, 0, 0] and aho[1][1] == [2, 4, 0] and aho[4][1] == [2, 1, 0]


def test_lexicon_round_trip_through_a_table(spark, scratch):
    from sectorscope.functions.lexicon import read_lexicon
    path = scratch("lexicon") + ".csv"
    default_lexicon().to_df(spark).orderBy("kw_ord").write.option("header", True).csv(path)
    assert read_lexicon(spark, path) == default_lexicon()


def test_large_lexicon_table_and_repeated_ids(spark):
    from pyspark.sql import functions as F
    from sectorscope.operators.lexicon_join import classify_by_join
    words = spark.range(6000).select((F.col("id") % 3 + 1).cast("int").alias("cat_ord"), F.concat(F.lit("cat"), F.col("id") % 3).alias("category"),
                                     (F.col("id") + 1).cast("int").alias("kw_ord"), F.format_string("kw%05d", "id").alias("keyword"))
    docs = spark.createDataFrame([(1, "kw00000 kw00003 kw00001"), (1, "kw00004"), (2, "nothing"), (3, None)], "id long, text string")
    got = sorted((r["id"], r["scores"]) for r in classify_by_join(docs, "id", "text", lex_df=words, keep_scores=True).collect())
    assert got == [(1, [0, 1, 0]), (1, [2, 1, 0]), (2, [0, 0, 0]), (3, [0, 0, 0])]


def test_scorer_is_explicit():
    from sectorscope.functions.scoring import resolve_scorer
    import pytest
    with pytest.raises(ValueError):
        resolve_scorer("auto")

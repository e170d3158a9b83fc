import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectorscope.operators import corrections, explore, findings, profiles
from sectorscope.plans.explain import plan_text
from sectorscope.sources import files
from sectorscope.sources.tables import read_table
from conftest import SF_SMALL


def test_running_sum_matches_single_window(spark):
    df = read_table(spark, SF_SMALL, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("f"))
    df = df.withColumn("o_orderkey", F.format_string("k%08d", "o_orderkey"))  # any orderable key
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = profiles.running_sum(df, "o_orderkey", F.col("f").cast("bigint"), "run")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert "SinglePartition" not in plan_text(df.repartitionByRange("o_orderkey"))
    w = Window.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("run", F.sum(F.col("f").cast("bigint")).over(w))
    assert sorted(got.select("o_orderkey", "run").collect()) == sorted(ref.select("o_orderkey", "run").collect())


def test_head_per_label_uses_partial_group_limit(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("company_id"),
                                     F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("Predicted_Archetype"),
                                     F.lit("Low").alias("Confidence_Score"), F.lit("").alias("Keywords_Found"))
    out = explore.head_per_label(df, "company_id", 5)
    plan = plan_text(out)
    assert "WindowGroupLimit" in plan
    rows = out.collect()
    assert len(rows) == 10 and sorted(r["company_id"] for r in rows if r["Predicted_Archetype"] == "A") == [0, 3, 6, 9, 12]


def test_search_is_case_insensitive_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, "Hello", None), (2, None, "none"), (3, "x", "y")], "id long, a string, b string")
    assert [r["id"] for r in explore.search(df, "HELLO").collect()] == [1]
    assert [r["id"] for r in explore.search(df, "None").collect()] == [2]
    assert explore.search(df, "a.b", literal=True).count() == 0


def test_search_ignores_case_beyond_ascii(spark):
    df = spark.createDataFrame([(1, "École du Soir"), (2, "niño"), (3, "plain")], "id int, t string")
    assert [r["id"] for r in explore.search(df, "ÉCOLE|NIÑO").orderBy("id").collect()] == [1, 2]


def test_findings_text(spark):
    df = spark.createDataFrame([("Enablers", "", "DC1, DC2", "3.0"), ("Enablers", "Connectors", "DC1", "2.0"),
                                ("API Error", "", "", "")],
                               "Predicted_Archetype string, Secondary_Archetypes string, "
                               "Driving_Capabilities string, Innovation_Wave string")
    got = {r["finding"]: r for r in findings.render_text(findings.findings(df)).collect()}
    assert got["dominant_archetype"]["text"] == "**Enablers** is the dominant archetype with 2 companies (100.0%)"
    assert got["classification_quality"]["text"] == "**66.7%** successful classifications (2/3 companies)"
    assert got["top_capability"]["label"] == "DC1"
    assert got["innovation_maturity"]["value"] == 50.0
    assert got["hybrid_models"]["n"] == 1


def test_findings_dominant_share_counts_null_labels(spark):
    # a null label is not an error: it stays in the share's base, though it is no candidate
    df = spark.createDataFrame([("Enablers", "3.0"), ("Enablers", "3.0"), (None, "3.0"), ("API Error", "")],
                               "Predicted_Archetype string, Innovation_Wave string")
    df = df.selectExpr("*", "'' AS Secondary_Archetypes", "'' AS Driving_Capabilities")
    got = {r["finding"]: r for r in findings.render_text(findings.findings(df)).collect()}
    assert got["dominant_archetype"]["label"] == "Enablers" and got["dominant_archetype"]["n"] == 2
    assert got["dominant_archetype"]["text"].endswith("with 2 companies (66.7%)")


def test_csv_scan_nulls_and_mapping(spark, scratch):
    path = scratch("csv") + ".csv"
    os.makedirs(path)
    with open(f"{path}/part-0.csv", "w") as fh:
        fh.write('Company,Full Description,Founded\n"A, Inc","multi\nline",2001\nB,N/A,\nC,"",#N/A\n')
    df = files.scan(spark, path)
    assert df.columns == ["Company", "Full Description", "Founded"]
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("A, Inc", "multi\nline", "2001"), ("B", None, None), ("C", None, None)]
    assert files.column_mapping(df.columns) == ("Company", "Full Description")
    assert files.column_mapping(["id", "name", "x"], rule="upload") == ("id", "name")
    assert files.column_mapping(["only"]) == ("only", "only")
    for bad in ("x.xlsx", "x.txt"):
        try:
            files.format_of(bad)
            raise AssertionError("expected error")
        except ValueError:
            pass


def test_founding_year_rule(spark):
    nums = spark.createDataFrame([("1999",), ("x",), ("2015",)], "founded string")
    assert [r["Founded_Year"] for r in corrections.founding_year(nums).collect()] == [1999.0, None, 2015.0]
    dates = spark.createDataFrame([("2001-05-01",), ("03/02/2012",), ("1999",), ("bad",)], "launch_date string")
    assert [r["Founded_Year"] for r in corrections.founding_year(dates).collect()] == [2001.0, 2012.0, 1999.0, None]
    aged = corrections.age_correction(spark.createDataFrame(
        [("Innovators", 2001.0), ("Innovators", 2015.0), ("Enablers", 2001.0), ("Disruptors", None)],
        "Predicted_Archetype string, Founded_Year double"), cutoff=2010)
    assert [(r[0], r[2]) for r in aged.collect()] == [("Traditional / Generalist", True), ("Innovators", None),
                                                      ("Enablers", None), ("Disruptors", None)]


def test_empty_input_guards(spark):
    schema = ("company_id long, Predicted_Archetype string, Confidence_Score string, Keywords_Found string, "
              "Secondary_Archetypes string, Driving_Capabilities string, Innovation_Wave string")
    empty = spark.createDataFrame([], schema)
    assert profiles.success_rate(empty).first()["success_rate"] == 0.0
    assert profiles.success_rate_exact(empty).first()["success_rate"] is None
    for fn in (profiles.dominant_archetype, profiles.archetype_summary, profiles.wave_profile,
               profiles.top_capability, profiles.capability_top10):
        assert fn(empty).count() == 0, fn.__name__
    got = {r["finding"]: r for r in findings.findings(empty).collect()}
    assert set(got) == {"classification_quality", "ecosystem_diversity"}
    assert got["classification_quality"]["value"] == 0.0 and got["ecosystem_diversity"]["n"] == 0
    assert explore.filter_counts(empty, ["Hybrid"]).first().asDict() == {"n_shown": 0, "n_total": 0}


def test_wave_profile_nulls(spark):
    # null waves are no wave row but count in the base; null labels are no top label
    rows = [("A", "3.0"), ("A", "3.0"), ("B", "3.0"), (None, "3.0"), (None, "3.0"), (None, "3.0"),
            ("A", None), ("C", "1.0")]
    df = spark.createDataFrame(rows, "Predicted_Archetype string, Innovation_Wave string")
    got = {r["Innovation_Wave"]: r for r in profiles.wave_profile(df).collect()}
    assert set(got) == {"3.0", "1.0"}
    assert got["3.0"]["n"] == 6 and got["3.0"]["pct"] == 75.0
    assert got["3.0"]["top_archetypes"] == "A: 2, B: 1"
    assert got["1.0"]["top_archetypes"] == "C: 1" and got["1.0"]["pct"] == 12.5


def test_archetype_summary_ties_and_nulls(spark):
    rows = [("A", "3.0", "DC2"), ("A", "3.0", "DC2, DC1"), ("A", "2.0", ""), ("A", "2.0", "DC5"),
            ("A", None, "DC1"), ("B", None, ""), (None, "1.0", "")]
    df = spark.createDataFrame(rows, "Predicted_Archetype string, Innovation_Wave string, "
                                     "Driving_Capabilities string")
    got = {r["Predicted_Archetype"]: r for r in profiles.archetype_summary(df).collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    assert a["n"] == 5 and abs(a["pct"] - 500 / 7) < 1e-9
    assert a["dominant_wave"] == "2.0"                 # 2 x "3.0" and 2 x "2.0": ties go to the smaller
    assert a["top_capabilities"] == "DC1, DC2, DC5"   # 2, 2, 1 mentions; ties in column order
    assert got["B"]["dominant_wave"] is None and got["B"]["top_capabilities"] is None


def test_processed_count_skips_empty_labels(spark):
    df = spark.createDataFrame([("A",), ("",), (None,), ("B",)], "Predicted_Archetype string")
    r = profiles.processed_count(df).first()
    assert (r["n_done"], r["n_saved"]) == (2, 4)


def test_founding_year_builds_without_a_job(spark):
    # the whole-column number/date choice is a scalar subquery: no job until an action
    df = spark.createDataFrame([("1999",), ("2012",), ("n/a",)], "founded string")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = corrections.founding_year(df)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert sorted(r["Founded_Year"] for r in out.collect() if r["Founded_Year"] is not None) == [1999.0, 2012.0]


def test_strip_matches_python(spark):
    from hypothesis import given, settings, strategies as st
    chars = st.sampled_from(list("DC1 ,x") + [" ", "\t", "\n", "\r", "\u00a0", "\u2003", "\u3000", "\x0b", "\x0c"])

    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.text(alphabet=chars, max_size=8), min_size=1, max_size=6))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = [r[0] for r in df.select(profiles.strip(F.col("v"))).collect()]
        assert got == [v.strip() for v in values]

    check()


def test_sorted_outputs_and_small_rules(spark):
    rows = [("B", "2.0", "DC2", "2015-03-01T10:00:00Z"), ("A", "1.0", "DC1", "March 2012"), ("B", "1.0", "DC1, DC2", "2015-03-01T00:00:00"), ("C", None, "", "x")]
    df = spark.createDataFrame(rows, "Predicted_Archetype string, Innovation_Wave string, Driving_Capabilities string, founded string")
    assert [r[0] for r in profiles.archetype_counts_all(df).collect()] == ["B", "A", "C"]
    assert [r[0] for r in profiles.wave_share(df).collect()] == ["1.0", "2.0"]
    own = spark.createDataFrame([("DC", "DC")], "DC2 string, DC1 string")
    assert profiles.top_capability(own).first()["DC"] == "DC2"
    years = [r["Founded_Year"] for r in corrections.founding_year(df, "founded").collect()]
    assert years == [2015.0, 2012.0, 2015.0, None]
    counts = explore.filter_counts(df, ["B"], pattern="march|z$").first()
    assert (counts["n_shown"], counts["n_total"]) == (1, 4)


def test_resume_skips_labelled_rows(spark):
    from sectorscope.operators.resume import pending_rows
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    saved = spark.createDataFrame([(1, "A"), (2, ""), (3, None), (1, "A")], "k long, Predicted_Archetype string")
    assert sorted((r[0] or 0) for r in pending_rows(df, saved, "k").collect()) == [0, 2, 3]


def test_csv_columns_go_by_name_in_each_file(spark, scratch):
    import os
    path = scratch("csv") + ".csv"
    os.makedirs(path)
    for name, body in {"a": "Company,Description\nX,cloud\n", "b": "Description,Company\nrisk,Y\n",
                       "c": "Company\nZ\n", "d": ""}.items():
        with open(f"{path}/{name}.csv", "w") as fh:
            fh.write(body)
    df = files.scan(spark, path)
    assert df.columns == ["Company", "Description"]
    assert sorted(map(tuple, df.collect()), key=str) == [("X", "cloud"), ("Y", "risk"), ("Z", None)]


def test_csv_repeated_and_missing_names(spark, scratch):
    import os
    path = scratch("csv") + ".csv"
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as fh:
        fh.write("a,a,,a.1\n1,2,3,4\n")
    df = files.scan(spark, path)
    assert df.columns == ["a", "a.2", "Unnamed: 2", "a.1"]
    assert tuple(df.first()) == ("1", "2", "3", "4")

from pyspark.sql import functions as F

from sectorscope.operators import responses as rs
from sectorscope.sources.tables import RESPONSES, companies, responses
from conftest import SF_SMALL


def test_parse_error_classes_and_defaults(spark):
    rows = [(k, v) for k, v in RESPONSES.items()] + [(11, '"text"'), (12, "12"), (13, "1.5"), (14, "true"),
                                                     (15, "null")]
    df = spark.createDataFrame(rows, "company_id long, response_json string")
    got = {r["company_id"]: r for r in rs.parse_responses(df).collect()}
    assert (got[0]["Predicted_Archetype"], got[0]["Confidence_Score"], got[0]["Keywords_Found"]) == \
        ("API Error - JSON", "Low", "JSON parse error")
    assert got[1]["Predicted_Archetype"] == "API Error"
    assert got[1]["Keywords_Found"] == "Error: 'list' object has no attribute 'get'"
    assert got[11]["Keywords_Found"].endswith("'str' object has no attribute 'get'")
    assert got[12]["Keywords_Found"].endswith("'int' object has no attribute 'get'")
    assert got[13]["Keywords_Found"].endswith("'float' object has no attribute 'get'")
    assert got[14]["Keywords_Found"].endswith("'bool' object has no attribute 'get'")
    assert got[15]["Keywords_Found"].endswith("'NoneType' object has no attribute 'get'")
    r2 = got[2]
    assert (r2["Predicted_Archetype"], r2["Confidence_Score"], r2["Keywords_Found"], r2["Secondary_Archetypes"],
            r2["Driving_Capabilities"], r2["Innovation_Wave"]) == ("Unclassified", "Medium", "", "", "", "")
    assert (got[3]["Predicted_Archetype"], got[3]["Confidence_Score"]) == ("Unclassified", "Low")
    assert got[5]["Innovation_Wave"] == "3.0" and got[5]["Driving_Capabilities"] == "DC1, DC5"
    assert got[6]["Keywords_Found"] == "x" * 200 + "..." and got[6]["Secondary_Archetypes"] == "Connectors"
    assert got[7]["Secondary_Archetypes"] == "" and got[7]["type_mismatch"] is True
    assert got[8]["Secondary_Archetypes"] == "Enablers, Disruptors"


def test_merge_keeps_keywords_for_missing_responses(spark):
    from sectorscope.operators.classify import classify_companies
    from sectorscope.sources.tables import COMPANY_AUX
    kw = classify_companies(companies(spark, SF_SMALL), "Description", COMPANY_AUX)
    parsed = rs.parse_responses(rs.answered(responses(spark, SF_SMALL)))
    merged = rs.merge_with_keywords(kw, parsed)
    assert merged.count() == kw.count()
    # no answer when k % 20 = 4 (k % 20 = 14 is a failed call, which answers with an error)
    bad = merged.filter((F.col("company_id") % 20 == 4) != (F.col("result_source") == "keywords")).count()
    assert bad == 0
    errs = rs.merge_with_keywords(kw, parsed, errors_to_keywords=True)
    assert errs.filter(F.col("Predicted_Archetype").contains("Error")).count() == 0


def test_prompt_rendering(spark):
    df = spark.createDataFrame([("Acme", "x" * 600, "Cyber")], "name string, text string, ind string")
    p = rs.render_requests(df, F.col("name"), F.col("text"), F.col("ind")).first()["prompt"]
    expected = rs.PROMPT_TEMPLATE.format(framework_context=rs.FRAMEWORK_CONTEXT, company_name="Acme",
                                         description="x" * 500, industries="Cyber")
    assert p == expected


def test_pandas_responder_sees_prompts(spark):
    from sectorscope.functions import text as tx
    from sectorscope.operators.classify import classify_companies
    from sectorscope.sources.tables import COMPANY_AUX

    def fake_model(pdf):
        out = pdf[["company_id"]].copy()
        out["response_json"] = ['{"archetype":"Enablers","confidence":"High","innovation_wave":"%d.0"}'
                                % (1 + len(p) % 3) if "Nombre:" in p else "bad" for p in pdf["prompt"]]
        return out

    c = companies(spark, SF_SMALL)
    kw = classify_companies(c, "Description", COMPANY_AUX)
    out = rs.classify_with_model(c, kw, rs.pandas_responder(fake_model), tx.company_name(c),
                                 tx.combined_text(c, "Description", COMPANY_AUX), tx.industries(c))
    rows = out.collect()
    assert len(rows) == c.count()
    assert {r["Predicted_Archetype"] for r in rows} == {"Enablers"}
    assert {r["result_source"] for r in rows} == {"model"}


def test_failed_request_is_a_processing_error(spark):
    from sectorscope.functions import text as tx
    from sectorscope.operators.classify import classify_companies
    from sectorscope.sources.tables import COMPANY_AUX

    message = "model unavailable: " + "z" * 150

    def flaky_model(pdf):
        if (pdf["company_id"] % 7 == 0).any():  # one bad request fails the whole call
            raise RuntimeError(message)
        out = pdf[["company_id"]].copy()
        out["response_json"] = '{"archetype":"Enablers"}'
        return out

    c = companies(spark, SF_SMALL)
    kw = classify_companies(c, "Description", COMPANY_AUX)
    out = rs.classify_with_model(c, kw, rs.pandas_responder(flaky_model), tx.company_name(c),
                                 tx.combined_text(c, "Description", COMPANY_AUX), tx.industries(c))
    rows = {r["company_id"]: r for r in out.collect()}
    assert len(rows) == c.count()
    bad = [r for k, r in rows.items() if k % 7 == 0]
    good = [r for k, r in rows.items() if k % 7 != 0]
    assert bad and all(r["Predicted_Archetype"] == "Processing Error" and r["Confidence_Score"] == "Low"
                       and r["Keywords_Found"] == message[:100] for r in bad)
    assert good and all(r["Predicted_Archetype"] == "Enablers" for r in good)
    # with the flag, failures fall back to keywords like other error responses
    back = rs.classify_with_model(c, kw, rs.pandas_responder(flaky_model), tx.company_name(c),
                                  tx.combined_text(c, "Description", COMPANY_AUX), tx.industries(c),
                                  errors_to_keywords=True)
    assert back.filter("Predicted_Archetype = 'Processing Error'").count() == 0


def test_white_space_and_repeated_keys(spark):
    cases = {'\n {"archetype":"Enablers"}\t': "Enablers", '{"archetype":"A","archetype":"B"}': "B", "\t[1]": "API Error",
             "\n": "API Error - JSON", '\r\n"x" ': "API Error", '{"archetype":"A"} x': "API Error - JSON"}
    df = spark.createDataFrame(list(enumerate(cases)), "company_id long, response_json string")
    got = {r["response_json"]: r for r in rs.parse_responses(df).collect()}
    assert {k: r["Predicted_Archetype"] for k, r in got.items()} == cases
    assert "'list'" in got["\t[1]"]["Keywords_Found"] and "'str'" in got['\r\n"x" ']["Keywords_Found"]


def test_one_answer_a_key(spark):
    kw = spark.createDataFrame([("a", *["k"] * 6), ("b", *["k"] * 6)], "company_id string, " + ", ".join(f"{c} string" for c in rs.RESULT_COLUMNS))
    stored = spark.createDataFrame([("a", "broken"), ("a", '{"archetype":"Z"}'), ("a", '{"archetype":"Y"}')], "company_id string, response_json string")
    got = {r["company_id"]: r["Predicted_Archetype"] for r in rs.merge_with_keywords(kw, rs.parse_responses(stored)).collect()}
    assert got == {"a": "Y", "b": "k"}


def test_each_request_is_sent_once(spark, scratch):
    import os
    from pyspark.sql import functions as F
    from sectorscope.operators import findings, profiles
    log = scratch("asked").removeprefix("file:")
    os.makedirs(log)

    def model(pdf):
        for k in pdf["company_id"]:
            with open(f"{log}/{k}", "a") as f:
                f.write("x")
        if pdf["company_id"].iloc[0] == "c3":
            raise RuntimeError("down")
        return pdf[["company_id"]].assign(response_json='{"archetype":"Enablers","innovation_wave":"2.0","driving_capabilities":["DC1"]}')

    c = spark.range(20).select(F.concat(F.lit("c"), "id").alias("company_id"), F.lit("cloud").alias("t"))
    kw = c.select("company_id", *[F.lit("k").alias(x) for x in rs.RESULT_COLUMNS])
    out = rs.classify_with_model(c, kw, rs.pandas_responder(model), F.col("company_id"), F.col("t"), F.col("t"))
    findings.findings(out).collect()
    profiles.wave_profile(out).collect()
    assert {f: os.path.getsize(f"{log}/{f}") for f in os.listdir(log)} == {f"c{i}": 1 for i in range(20)}
    assert out.where("Predicted_Archetype = 'Processing Error'").count() == 1


def test_cost_estimate_per_company():
    assert rs.FRAMEWORK_TOKENS + rs.EXTRA_INPUT_TOKENS == 458 and rs.OUTPUT_TOKENS_PER_COMPANY == 250


def test_parsing_leaves_the_session_as_it_is(spark):
    from sectorscope.operators.responses import parse_responses
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    texts = ['{"archetype":"A","archetype":"Enablers"}', '{"archetype":"A"} x', "1],[2", '[1, 2], "b": [3', "{'archetype':'A'}", '{"a":NaN}',
             '{"archetype":"A","archetype":"B"', '[{"a":1,"a":2}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "company_id int, response_json string")
    got = {r["company_id"]: (r["error_class"], r["Predicted_Archetype"]) for r in parse_responses(df).collect()}
    assert spark.conf.get(name, None) == before
    assert got[0] == (None, "Enablers") and got[7][0] == "api"
    assert all(got[i][0] == "json" for i in (1, 2, 3, 4, 6)), got

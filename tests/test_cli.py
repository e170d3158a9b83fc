"""The command line end to end: keyword mode, model mode with stored responses, CSV output."""
import os

from sectorscope import cli

ROWS = [("1", "TechInsure", "A SaaS platform to digitize insurers.", "2015"),
        ("2", "AutoClaimAI", "Automation and AI-driven instant claims.", "2003"),
        ("3", "Nothing", "Makes garden furniture.", "")]


def _write_input(path):
    os.makedirs(path)
    with open(f"{path}/part-0.csv", "w") as fh:
        fh.write("company_id,Company,Description,Founded\n")
        for r in ROWS:
            fh.write(",".join(f'"{v}"' for v in r) + "\n")


def test_cli_keywords_with_age_correction(spark, scratch, capsys):
    src, out = scratch("cli-in") + ".csv", scratch("cli-out")
    _write_input(src)
    path = cli.main([src, "--out", out, "--age-cutoff", "2010", "--run-id", "r1"], spark=spark)
    got = {r["Company"]: r for r in spark.read.parquet(path).collect()}
    assert got["TechInsure"]["Predicted_Archetype"] == "Enablers"
    assert got["AutoClaimAI"]["Predicted_Archetype"] == "Traditional / Generalist"  # Disruptors, founded 2003
    assert got["AutoClaimAI"]["Age_Corrected"] is True
    assert got["Nothing"]["Predicted_Archetype"] == "Unclassified"
    assert path.endswith("mode=keywords/run_id=r1")
    assert "rows: 3, columns: 4" in capsys.readouterr().out


def test_cli_model_mode_csv_output(spark, scratch):
    src, out, resp = scratch("cli-in") + ".csv", scratch("cli-out"), scratch("cli-resp") + ".parquet"
    _write_input(src)
    spark.createDataFrame([("1", '{"archetype":"Integrators","driving_capabilities":["DC1"],"innovation_wave":"3.0"}')],
                          "company_id string, response_json string").write.parquet(resp)
    path = cli.main([src, "--out", out, "--name", "1", "--desc", "Description", "--mode", "model",
                     "--responses", resp, "--format", "csv", "--run-id", "r2"], spark=spark)
    got = {r["company_id"]: r for r in spark.read.option("header", True).csv(path).collect()}
    assert got["1"]["Predicted_Archetype"] == "Integrators" and got["1"]["Driving_Capabilities"] == "DC1"
    assert got["2"]["Predicted_Archetype"] == "Disruptors"  # no stored answer: keywords


def test_cli_rejects_bad_choices(spark, scratch):
    import pytest
    src, out = scratch("cli-in") + ".csv", scratch("cli-out")
    _write_input(src)
    with pytest.raises(SystemExit, match="no column"):
        cli.main([src, "--out", out, "--desc", "Nope"], spark=spark)
    with pytest.raises(SystemExit, match="needs --responses"):
        cli.main([src, "--out", out, "--mode", "model"], spark=spark)
    with pytest.raises(SystemExit, match="is not a column"):
        cli.main([src, "--out", out, "--mode", "model", "--responses", src, "--key", "id"], spark=spark)

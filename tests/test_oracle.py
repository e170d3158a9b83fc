"""Every registered query against its DuckDB SQL, at sf0.001."""
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

import sys, os
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import digest, duck  # noqa: E402

from sectorscope.plans import catalog  # noqa: E402
from sectorscope.plans.explain import final_plan, plan_text  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    plan = plan_text(df)
    for banned in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert banned not in plan, f"{name}: {banned}"
    # every row is scored once: one scoring step per query in the final plan
    # (resume_pending scores the saved rows and the pending rows apart)
    final = final_plan(df)
    sites = 1
    assert final.count("ArrowEvalPython") <= sites, name
    # the classifier's fence marks each place it is evaluated, for every scorer
    assert final.count("SPARK_PARTITION_ID()") <= sites, name
    if name not in SQL:
        assert rows, name
        return
    res = con.execute(SQL[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["Predicted_Archetype", "n"]

"""Registered queries vs their DuckDB SQL oracle on sf0.001 (a representative subset;
tools/check_oracle.py runs all of them)."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
SUBSET = ["work_hours", "financial_summary", "department_summary", "efficiency_distribution",
          "overall_profitability", "top_efficient_projects", "features", "cost_ratio_by_type",
          "pattern_anomalies", "risk_scores", "risk_recommendations", "lof_embeddings", "imputed_costs",
          "feature_anova_f", "gs_sheet_status"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ok, msg = compare(sdf, res.fetchall(), [d[0] for d in res.description])
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 10
    assert df.columns == ["ProjectCode", "ProjectName", "EfficiencyScore", "Profit", "TotalHours"]

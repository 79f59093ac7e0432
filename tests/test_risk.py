"""Risk scorer properties on the sf0.001 tables."""
import pytest
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.operators import risk
from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    f = registry._features(spark, SF)
    flags = f.select("row_id", (F.col("row_id") % 7 == 0).alias("IsAnomaly"))
    return f, risk.calculate_risk_scores(f, flags).cache()


def test_components_in_range_and_weights(spark, scored):
    _, r = scored
    assert abs(sum(w for _, w in config.RISK_WEIGHTS) - 1.0) < 1e-12
    row = r.agg(*[F.min(c).alias(f"lo_{c}") for c in risk.COMPONENTS + ["TotalRiskScore"]],
                *[F.max(c).alias(f"hi_{c}") for c in risk.COMPONENTS + ["TotalRiskScore"]]).collect()[0]
    for c in risk.COMPONENTS + ["TotalRiskScore"]:
        assert 0.0 <= row[f"lo_{c}"] and row[f"hi_{c}"] <= 100.0
    # pipeline columns: efficiency <= 70, complexity <= 30, timeline <= 55
    assert row["hi_EfficiencyRisk"] <= 70.0 and row["hi_ComplexityRisk"] <= 30.0 and row["hi_TimelineRisk"] <= 55.0


def test_levels_and_flags(spark, scored):
    _, r = scored
    bad = r.where((F.col("IsHighRisk") != (F.col("TotalRiskScore") > 60)) |
                  (F.col("AnomalyRisk").isin(0.0, 100.0) == False)).count()  # noqa: E712
    assert bad == 0
    hist = {x["RiskLevel"]: x["count"] for x in risk.level_histogram(r).collect()}
    assert set(hist) == {name for name, _, _ in config.RISK_LEVELS}          # zero counts kept
    assert sum(hist.values()) == r.where(F.col("RiskLevel").isNotNull()).count()


def test_summary_and_recommendations(spark, scored):
    f, r = scored
    s = risk.risk_summary(r).collect()[0]
    assert s["total_projects"] == f.count()
    assert s["primary_risk_driver"] in {"financial", "efficiency", "complexity", "timeline", "anomaly"}
    recs = risk.recommendations(r).collect()
    for rec in recs:
        assert rec["count"] > 0 and 1 <= len(rec["affected_projects"]) <= 5
    top = risk.high_risk_projects(r, f, top_n=5).collect()
    assert len(top) == 5 and all(t["PrimaryRiskFactor"] in {"Financial", "Efficiency", "Complexity", "Timeline",
                                                              "Anomaly"} for t in top)


def test_full_columns_and_threshold_mode(spark, scored):
    f, _ = scored
    p, wh = registry._inputs(spark, SF)
    full = risk.with_full_columns(f, registry.finance.financial_summary(p, wh, registry.DEPTS))
    r1 = risk.calculate_risk_scores(full)
    assert r1.agg(F.max("ComplexityRisk")).collect()[0][0] > 30.0      # department/task ranks now present
    r2 = risk.calculate_risk_scores(f, mode="threshold")
    assert r2.where((F.col("FinancialRisk") < 0) | (F.col("FinancialRisk") > 100)).count() == 0

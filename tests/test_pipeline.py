"""End-to-end batch run on sf0.001, without and with the model stage, plus sinks."""
import tempfile

from pyspark.sql import functions as F

from tallyspark.plans import pipeline, registry
from tallyspark.sources import given

SF = "/root/testdata/sf0.001"


def test_pipeline_end_to_end(spark):
    p, wh = given.projects(spark, SF), given.work_hours(spark, SF)
    res = pipeline.run(wh, p, registry.DEPTS, registry.KEYS, models=False)
    t = res.tables
    n = p.count()
    assert res.impute_method == "model"
    assert t["features"].count() == n and t["risk_scores"].count() == n
    assert t["project_analysis"].count() == n
    # imputation filled every price and cost
    assert t["financial_summary"].where((F.col("ContractPrice") <= 0) | (F.col("PurchaseCost") <= 0)).count() == 0
    assert t["feature_summary"].collect()[0]["total_features"] == 52
    sections = {r["section"] for r in t["report_lines"].collect()}
    assert {"summary", "risk", "risk_distribution", "recommendations", "insights", "technical"} <= sections
    lines = t["report_lines"].orderBy("section_no", "seq").collect()
    assert [r["seq"] for r in lines if r["section"] == "top_high_risk"] == list(range(5))
    assert len({(r["section_no"], r["seq"]) for r in lines}) == len(lines)
    assert "Primary risk driver" in {r["key"] for r in t["console_summary"].collect()}
    assert not any("Isolation" in r["value"] for r in lines)
    assert t["console_summary"].where(F.col("section") == "insights").count() <= 3
    out = tempfile.mkdtemp(prefix="tally-pipe-")
    paths = pipeline.save(res, out)
    assert len(paths) == len(t)
    assert spark.read.option("header", True).csv(f"{out}/project_analysis").count() == n


def test_pipeline_with_models(spark):
    """Every table that rests on the detectors, rebuilt in pandas from their masks."""
    p, wh = given.projects(spark, SF), given.work_hours(spark, SF)
    res = pipeline.run(wh, p, registry.DEPTS, registry.KEYS)
    t = {k: res.tables[k].toPandas() for k in ("project_analysis", "risk_scores", "anomaly_method_report", "consensus_anomalies", "report_lines", "console_summary",
                                               "insights", "risk_summary", "selected_features", "anomaly_counts")}
    masks = res.ensemble.results.toPandas().set_index("row_id")
    votes = masks[["if_vote", "lof_vote", "svm_vote"]].sum(axis=1)
    assert (votes == masks.detection_count).all() and ((votes >= 2) == masks.consensus).all()
    flagged = set(masks.index[votes >= 2])
    assert flagged and set(t["consensus_anomalies"].row_id) == flagged
    mart = t["project_analysis"].set_index("row_id")
    assert set(mart.index[mart.IsAnomaly]) == flagged and len(mart) == len(masks)
    risk = t["risk_scores"].set_index("row_id")
    assert (risk.AnomalyRisk == [100.0 if i in flagged else 0.0 for i in risk.index]).all()
    report = t["anomaly_method_report"].set_index("method")
    for method, flag in (("isolation_forest", "if_flag"), ("local_outlier_factor", "lof_flag"), ("one_class_svm", "svm_flag")):
        assert report.loc[method, "anomalies_found"] == masks[flag].sum()
        assert abs(report.loc[method, "percentage"] - 100 * masks[flag].mean()) < 1e-9
    assert report.loc["consensus", "anomalies_found"] == len(flagged)
    lines = t["report_lines"]
    value = lambda section, key: lines[(lines.section == section) & (lines.key == key)].value.iloc[0]
    assert value("summary", "Anomalies Detected") == str(len(flagged))
    assert value("anomaly_methods", "local_outlier_factor").startswith(f"{masks.lof_flag.sum()} anomalies (")
    first = sorted(flagged)[:5]
    assert list(lines[lines.section == "anomaly_samples"].sort_values("seq").key) == list(mart.loc[first].ProjectCode)
    assert len(lines[lines.section == "technical"]) == 9 and len(t["selected_features"]) == 20
    console = t["console_summary"]
    assert console[console.key == "Consensus anomalies found"].value.iloc[0] == str(len(flagged))
    general = t["insights"][t["insights"].type == "general_anomaly"]
    assert list(general.description) == [f"{len(flagged)} projects flagged by multiple anomaly detection methods"]
    high = int(t["risk_summary"].high_risk_count.iloc[0])
    assert (risk.TotalRiskScore > 60).sum() == high

"""The full batch run as a chain of Spark stages.

load -> impute -> financials -> merge -> features -> detect -> score ->
insights -> save.  Each stage that later stages read more than once is
materialised with a reliable checkpoint into the shared checkpoint folder
(executor loss then costs a re-read, not a recomputation of everything
upstream).  Model fits are the only other actions.  The result is a dict of
lazily defined result DataFrames; ``save`` writes them with the sinks.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.operators import finance, impute, risk, rules, selection
from tallyspark.operators import features as feat
from tallyspark.plans import reports
from tallyspark.session import cut_lineage
from tallyspark.sources import sinks


@dataclass
class RunResult:
    tables: dict[str, DataFrame]
    impute_method: str
    timings: dict[str, float] = field(default_factory=dict)
    ensemble: object | None = None


def run(work_hours: DataFrame, projects: DataFrame, departments: list[str] | None = None,
        key_departments: list[str] | None = None, models: bool = True, knn_args: dict | None = None,
        impute_method: str = "model") -> RunResult:
    key_departments = key_departments or config.KEY_DEPARTMENTS
    t: dict[str, float] = {}
    clock = time.time()

    def lap(name):
        nonlocal clock
        now = time.time()
        t[name] = round(now - clock, 3)
        clock = now

    wh = cut_lineage(work_hours)
    lap("load")
    proj = cut_lineage(impute.impute(projects, wh, departments, method=impute_method))
    lap("impute")
    fs = cut_lineage(finance.financial_summary(proj, wh, departments))
    dept = finance.department_summary(wh, departments)
    lap("financials")
    merged = finance.merge_financials(proj, fs)
    features = cut_lineage(feat.create_features(wh, merged, key_departments))
    lap("features")

    ens = None
    flags = None
    stages = ("detection", "selection") * models + ("price model",) * (impute_method == "model")
    tables: dict[str, DataFrame] = {}
    if models:
        from tallyspark.operators.anomaly import ensemble
        ens = ensemble.fit(features, feat.numeric_feature_names(features), knn_args=knn_args)
        flags = ensemble.consensus_flags(ens)
        from tallyspark.operators.anomaly import matrix
        tables["selected_features"] = selection.select_top(selection.mutual_information(
            matrix.prepare(features, ens.cols, target="Success"), ens.cols, method="neighbours"))
        tables["anomaly_method_report"] = ensemble.method_report(ens)
        tables["consensus_anomalies"] = ensemble.consensus_anomalies(ens).join(
            features.select("row_id", "ProjectCode", "ProjectName", "Status", "ContractPrice"), "row_id", "left")
    lap("detect")
    cost = rules.cost_anomalies(features)
    eff = rules.efficiency_anomalies(features)
    pat = rules.pattern_anomalies(wh)
    counts = rules.anomaly_counts(cost, eff, pat)
    lap("rules")

    scores = cut_lineage(risk.calculate_risk_scores(features, flags))
    summary = risk.risk_summary(scores)
    recs = risk.recommendations(scores)
    high = risk.high_risk_projects(scores, features, top_n=15)
    hist = risk.level_histogram(scores)
    lap("score")

    consensus_count = None
    if flags is not None:
        consensus_count = flags.agg(F.count_if("IsAnomaly").alias("count"))
    cost_count = counts.where(F.col("anomaly_type") == "cost").select("count")
    ins = reports.insights(summary, recs, cost_count, consensus_count)
    fsum = reports.feature_summary(features)
    mart = reports.project_mart(features, scores, flags)
    lines = reports.report_lines(fsum, summary, hist, high, recs, tables.get("anomaly_method_report"), counts,
                                 tables.get("consensus_anomalies"), ins, consensus_count, stages)
    tables.update({
        "financial_summary": fs, "department_summary": dept, "features": features,
        "feature_summary": fsum, "cost_anomalies": cost, "efficiency_anomalies": eff,
        "pattern_anomalies": pat, "anomaly_counts": counts, "risk_scores": scores, "risk_summary": summary,
        "risk_level_histogram": hist, "high_risk_projects": high, "recommendations": recs,
        "risk_by_type": risk.risk_by_type(features, scores), "risk_by_status": risk.risk_by_status(features, scores),
        "insights": ins, "project_analysis": mart, "report_lines": lines,
        "console_summary": reports.console_summary(lines, ins, summary, consensus_count),
    })
    tables.update({f"efficiency_{k}": v for k, v in finance.efficiency_analysis(fs).items()})
    tables.update({f"profitability_{k}": v for k, v in finance.profitability_analysis(fs).items()})
    lap("insights")
    return RunResult(tables, impute_method, t, ens)


def save(result: RunResult, out_dir: str) -> list[str]:
    """K1 + K2: JSON per result set (arrays/maps kept as JSON), CSV for the mart."""
    json_sets = {k: v for k, v in result.tables.items() if k not in ("project_analysis",)}
    paths = sinks.write_results(json_sets, out_dir)
    paths.append(sinks.write_project_analysis(result.tables["project_analysis"], out_dir))
    return paths

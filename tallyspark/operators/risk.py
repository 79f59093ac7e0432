"""Risk scoring (B12-B17) and the risk summaries.

Plan shape.  Nulls are filled with exact medians, which come back as a few
numbers; the percentile ranks of the filled columns and the upper quantile of the filled
duration follow (``functions.ordered``).  No single-partition window anywhere.  The
components are then plain column arithmetic inside whole-stage codegen.

Each sub-score is defined over optional columns: a term is added only when
its input column exists (tested on the schema at plan time), as the source
system does.  ``mode="percentile"`` is the default; ``mode="threshold"`` is
the fixed-threshold variant.

Rank keys are compared at ``RANK_DECIMALS`` decimals: inputs such as a
sample std or an entropy carry order-dependent last bits, and a tie between
two equal projects must not hinge on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.functions import ordered
from tallyspark.functions.exprs import clip, first_argmax, risk_level, round_half_up
from tallyspark.session import cut_lineage

COMPONENTS = [c for c, _ in config.RISK_WEIGHTS]
MEDIAN_FILLED = ["CostRevenueRatio", "ProfitMargin", "RevenuePerHour", "EfficiencyScore", "HoursPerTask",
                 "NumDepartments", "NumTasks", "DepartmentDiversity", "WorkIntensityEarly", "ProjectDuration"]
ZERO_FILLED = ["WorkVariability", "WorkAcceleration"]
RANK_DECIMALS = 9


def _f(c: str) -> Column:
    return F.col(f"_f_{c}")


def _r(c: str) -> Column:
    return F.col(f"_r_{c}")


def _sel(cond: Column, a, b) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.when(cond, a).otherwise(b)


#: Columns that are ranked, and whether high values rank low.
RANKED = {"CostRevenueRatio": False, "ProfitMargin": True, "RevenuePerHour": True, "EfficiencyScore": True, "HoursPerTask": False,
          "WorkVariability": False, "NumDepartments": False, "NumTasks": False, "DepartmentDiversity": False}


def _with_ranks(g: DataFrame, id_col: str, present: set[str]) -> DataFrame:
    """``g`` with ``_r_`` (percentile ranks of the filled columns), the filled timeline columns and their upper quantile."""
    key = lambda c: round_half_up(F.col(c).cast("double"), RANK_DECIMALS) if c in RANKED else F.col(c).cast("double")
    ranked = [c for c in RANKED if c in present]
    filled = [c for c in MEDIAN_FILLED if c in present]
    fills = {}
    if filled:
        meds = ordered.quantile_row(g, {c: [0.5] for c in filled}, {c: key(c) for c in filled}, name=lambda m, p: m)
        fills = meds.select(*[(round_half_up(c, RANK_DECIMALS) if c in RANKED else F.col(c)).alias(c) for c in filled]).first().asDict()
    fills.update({c: 0.0 for c in ZERO_FILLED if c in present})
    whole = lambda c: F.coalesce(key(c), F.lit(fills[c]).cast("double"))
    for c in fills:
        if c not in RANKED:
            g = g.withColumn(f"_f_{c}", whole(c))
    if "ProjectDuration" in present:
        q = ordered.quantile_row(g.select("_f_ProjectDuration"), {"_f_ProjectDuration": [0.75]}, name=lambda m, p: "_q75_f_ProjectDuration")
        g = ordered.attach_scalars(g, q)
    if not ranked:
        return g
    ranks = ordered.pct_ranks(g, id_col, {f"_r_{c}": -whole(c) if RANKED[c] else whole(c) for c in ranked})
    return g.join(ranks, id_col, "left")


def _fill(features: DataFrame, present: set[str]) -> DataFrame:
    med_cols = [c for c in MEDIAN_FILLED if c in present]
    g = features
    if med_cols:
        meds = ordered.quantile_row(features, {c: [0.5] for c in med_cols}, name=lambda m, p: f"_med_{m}")
        g = ordered.attach_scalars(g, meds)
        for c in med_cols:
            g = g.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
    for c in ZERO_FILLED:
        if c in present:
            g = g.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return g


def calculate_risk_scores(features: DataFrame, anomaly_flags: DataFrame | None = None,
                          mode: str = "percentile", id_col: str = "row_id",
                          checkpoint: bool = True) -> DataFrame:
    """Component scores, weighted total, level and high-risk flag.

    ``anomaly_flags``: optional ``(id_col, flag)`` frame; a flagged project
    gets AnomalyRisk 100, others 0.
    """
    present = set(features.columns)
    has = lambda c: c in present
    # the features feed the medians, the ranks or quantiles and the scores: the few columns of these are staged once
    g = features.select(*[c for c in features.columns if c in {id_col, "ProjectCode", *RANKED, *MEDIAN_FILLED, *ZERO_FILLED}])
    g = cut_lineage(g) if checkpoint and not getattr(features, "_staged", False) else g
    if mode == "percentile":
        g = _with_ranks(g, id_col, present)
    else:
        g = _fill(g, present)
        qspec = {"_f_ProjectDuration": [0.75]} if has("ProjectDuration") else {}
        for c, ps in [("RevenuePerHour", [0.25]), ("HoursPerTask", [0.75]), ("NumTasks", [0.8]),
                      ("DepartmentDiversity", [0.1, 0.9])]:
            if has(c):
                qspec[f"_f_{c}"] = ps
        if qspec:
            g = ordered.attach_scalars(g, ordered.quantile_row(g, qspec, name=lambda m, p: f"_q{int(round(p * 100))}{m}"))
        if has("EfficiencyScore"):
            g = ordered.attach_scalars(g, g.agg(F.avg("_f_EfficiencyScore").alias("_eff_mu"),
                                                F.stddev_samp("_f_EfficiencyScore").alias("_eff_sd")))

    zero = F.lit(0.0)
    # B12 financial
    fin = zero
    if mode == "percentile":
        for c, w in [("CostRevenueRatio", 40), ("ProfitMargin", 30), ("RevenuePerHour", 30)]:
            if has(c):
                fin = fin + _r(c) * w
    else:
        if has("CostRevenueRatio"):
            fin = fin + clip((_f("CostRevenueRatio") - 0.7) * 100, 0.0, 40.0)
        if has("ProfitMargin"):
            m = _f("ProfitMargin")
            fin = fin + _sel(m < 0, 40, _sel(m < 10, 20 - m * 2, 0))
        if has("RevenuePerHour"):
            fin = fin + _sel(_f("RevenuePerHour") < F.col("_q25_f_RevenuePerHour"), 20, 0)
    # B13 efficiency
    eff = zero
    if mode == "percentile":
        for c, w in [("EfficiencyScore", 40), ("HoursPerTask", 30), ("WorkVariability", 30)]:
            if has(c):
                eff = eff + _r(c) * w
    else:
        if has("EfficiencyScore"):
            z = (_f("EfficiencyScore") - F.col("_eff_mu")) / F.col("_eff_sd")
            eff = eff + _sel(z < -1, 30, _sel(z < 0, 15, 0))
        if has("HoursPerTask"):
            eff = eff + _sel(_f("HoursPerTask") > F.col("_q75_f_HoursPerTask"), 20, 0)
        if has("WorkVariability"):
            eff = eff + clip(_f("WorkVariability") * 20, 0.0, 30.0)
    # B14 complexity
    cx = zero
    if mode == "percentile":
        for c, w in [("NumDepartments", 35), ("NumTasks", 35)]:
            if has(c):
                cx = cx + _r(c) * w
        if has("DepartmentDiversity"):
            cx = cx + F.abs(_r("DepartmentDiversity") - 0.5) * 2 * 30
    else:
        if has("NumDepartments"):
            nd = _f("NumDepartments")
            cx = cx + _sel(nd > 10, 30, _sel(nd > 7, 20, _sel(nd > 5, 10, 0)))
        if has("NumTasks"):
            cx = cx + _sel(_f("NumTasks") > F.col("_q80_f_NumTasks"), 25, 0)
        if has("DepartmentDiversity"):
            dv = _f("DepartmentDiversity")
            out = (dv < F.col("_q10_f_DepartmentDiversity")) | (dv > F.col("_q90_f_DepartmentDiversity"))
            cx = cx + _sel(F.coalesce(out, F.lit(False)), 25, 0)
    # B15 timeline
    tl = zero
    if has("WorkIntensityEarly"):
        w = _f("WorkIntensityEarly")
        tl = tl + _sel(F.coalesce(w < 0.1, F.lit(False)), 30, _sel(F.coalesce(w < 0.2, F.lit(False)), 15, 0))
    if has("WorkAcceleration"):
        a = _f("WorkAcceleration")
        tl = tl + _sel(a < -5, 25, _sel(a < 0, 10, 0))
    if has("ProjectDuration"):
        tl = tl + _sel(F.coalesce(_f("ProjectDuration") > F.col("_q75_f_ProjectDuration"), F.lit(False)), 20, 0)
        tl = tl + _sel(F.col("ProjectDuration").isNull(), 25, 0)

    if anomaly_flags is not None:
        fl = anomaly_flags.select(id_col, F.col(anomaly_flags.columns[1]).cast("double").alias("_flag"))
        g = g.join(fl, id_col, "left")
        anom = F.coalesce(F.col("_flag"), F.lit(0.0)) * 100.0
    else:
        anom = F.lit(0.0)

    g = g.select(id_col, "ProjectCode",
                 clip(fin, 0.0, 100.0).alias("FinancialRisk"), clip(eff, 0.0, 100.0).alias("EfficiencyRisk"),
                 clip(cx, 0.0, 100.0).alias("ComplexityRisk"), clip(tl, 0.0, 100.0).alias("TimelineRisk"),
                 anom.alias("AnomalyRisk"))
    total = F.lit(0.0)
    for c, w in config.RISK_WEIGHTS:
        total = total + F.col(c) * w
    g = g.withColumn("TotalRiskScore", total)
    return g.select(id_col, "ProjectCode", "TotalRiskScore", *COMPONENTS,
                    risk_level("TotalRiskScore").alias("RiskLevel"),
                    (F.col("TotalRiskScore") > config.HIGH_RISK_THRESHOLD).alias("IsHighRisk"))


def with_full_columns(features: DataFrame, summary: DataFrame, key: str = "row_id") -> DataFrame:
    """Features plus NumDepartments, NumTasks and HoursPerTask (the branches
    the pipeline's column set leaves dead, SURVEY 2.12 item 5)."""
    s = summary.select(key, "NumDepartments", "NumTasks",
                       F.try_divide(F.col("TotalHours"), F.col("NumTasks")).alias("HoursPerTask"))
    return features.join(s, key, "left")


# ---------------------------------------------------------------------------
# Summaries
# ---------------------------------------------------------------------------

_COMPONENT_KEYS = ["financial", "efficiency", "complexity", "timeline", "anomaly"]


def risk_summary(risk: DataFrame) -> DataFrame:
    """One row -- counts, mean score, component means, primary driver."""
    means = [F.avg(c).alias(k) for c, k in zip(COMPONENTS, _COMPONENT_KEYS)]
    s = risk.agg(F.count(F.lit(1)).alias("total_projects"),
                 F.count_if(F.col("IsHighRisk")).alias("high_risk_count"),
                 F.avg("TotalRiskScore").alias("average_risk_score"), *means)
    return s.withColumn("primary_risk_driver", first_argmax(_COMPONENT_KEYS))


def level_histogram(risk: DataFrame) -> DataFrame:
    """Count per level, zero counts kept (5-row dimension, broadcast)."""
    from tallyspark.sources.lookups import risk_levels
    dim = risk_levels(risk.sparkSession)
    counts = risk.where(F.col("RiskLevel").isNotNull()).groupBy("RiskLevel").agg(F.count(F.lit(1)).alias("count"))
    return (F.broadcast(dim).join(counts, "RiskLevel", "left")
            .select("RiskLevel", F.coalesce("count", F.lit(0)).alias("count"), "level_order")
            .orderBy(F.desc("count"), "level_order").drop("level_order"))


def risk_by_type(features: DataFrame, risk: DataFrame) -> DataFrame:
    """A20 (numeric part): mean/std/min/max of the total per project type."""
    j = features.select("ProjectCode", "ProjectType").join(
        risk.select("ProjectCode", "TotalRiskScore"), "ProjectCode")
    return j.groupBy("ProjectType").agg(
        F.avg("TotalRiskScore").alias("mean"), F.stddev_samp("TotalRiskScore").alias("std"),
        F.min("TotalRiskScore").alias("min"), F.max("TotalRiskScore").alias("max"))


def risk_levels_by_type(features: DataFrame, risk: DataFrame) -> DataFrame:
    """A20 (level counts) as rows (ProjectType, RiskLevel, count), zeros kept."""
    from tallyspark.sources.lookups import risk_levels
    j = features.select("ProjectCode", "ProjectType").join(
        risk.select("ProjectCode", "RiskLevel"), "ProjectCode")
    counts = j.where(F.col("RiskLevel").isNotNull()).groupBy("ProjectType", "RiskLevel").agg(
        F.count(F.lit(1)).alias("count"))
    levels = F.array(*[F.lit(name) for name, _, _ in config.RISK_LEVELS])
    grid = j.select("ProjectType").distinct().select("ProjectType", F.explode(levels).alias("RiskLevel"))
    return grid.join(counts, ["ProjectType", "RiskLevel"], "left").select(
        "ProjectType", "RiskLevel", F.coalesce("count", F.lit(0)).alias("count"))


def risk_level_map_by_type(features: DataFrame, risk: DataFrame) -> DataFrame:
    """A20 with the level counts as a map column, as the source reports it."""
    rows = risk_levels_by_type(features, risk)
    maps = rows.groupBy("ProjectType").agg(
        F.map_from_entries(F.collect_list(F.struct("RiskLevel", "count"))).alias("RiskLevel"))
    return risk_by_type(features, risk).join(maps, "ProjectType")


def risk_by_status(features: DataFrame, risk: DataFrame) -> DataFrame:
    """Mean and count of the total per status (Unknown excluded)."""
    j = features.where(F.col("Status") != "Unknown").select("ProjectCode", "Status").join(
        risk.select("ProjectCode", "TotalRiskScore"), "ProjectCode")
    return j.groupBy("Status").agg(F.avg("TotalRiskScore").alias("mean"),
                                   F.count("TotalRiskScore").alias("count"))


def high_risk_projects(risk: DataFrame, project_info: DataFrame, top_n: int = 10,
                       id_col: str = "row_id") -> DataFrame:
    """T3 (J8, P22): the top_n highest totals with project info and main driver."""
    top = risk.orderBy(F.desc("TotalRiskScore"), F.asc(id_col)).limit(top_n)
    info = project_info.select("ProjectCode", "ProjectName", "ProjectType", "ContractPrice", "Status")
    out = top.join(info, "ProjectCode", "left")
    return out.withColumn("PrimaryRiskFactor",
                          first_argmax(COMPONENTS, [c.replace("Risk", "") for c in COMPONENTS]))


# FIXED VALUES: category, severity, finding and action of the source's recommendations.
RECOMMENDATIONS = [
    ("Financial Risk", "High", "projects with high financial risk",
     "Review cost estimation and pricing strategies"),
    ("Complexity Risk", "Medium", "projects with high complexity",
     "Consider breaking down into smaller phases or adding PM resources"),
    ("Timeline Risk", "Medium", "projects with timeline concerns",
     "Implement early-stage project acceleration protocols"),
    ("Multiple Risk Factors", "Critical", "projects with multiple high risk factors",
     "Immediate review and intervention required"),
]


def recommendation_rules() -> list[Column]:
    """The four rule predicates, in report order."""
    c = F.col
    return [
        c("FinancialRisk") > 60,
        c("ComplexityRisk") > 60,
        c("TimelineRisk") > 60,
        ((c("FinancialRisk") > 50) & (c("EfficiencyRisk") > 50)) | ((c("ComplexityRisk") > 50) & (c("TimelineRisk") > 50)),
    ]


def recommendations(risk: DataFrame, id_col: str = "row_id", sample: int = 5) -> DataFrame:
    """One row per rule that fires: count and the first ``sample`` codes.

    Counts come from one aggregate; each rule's first codes from its own
    ``orderBy(id).limit(sample)`` (a bounded top-k per task, then a merge).
    """
    rules = recommendation_rules()
    counts = risk.agg(*[F.count_if(r).alias(f"n{i}") for i, r in enumerate(rules)])
    counts = counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("seq"), F.col(f"n{i}").alias("count")) for i in range(len(rules))])).alias("s")
    ).select("s.seq", "s.count")
    firsts = None
    for i, r in enumerate(rules):
        t = risk.where(r).orderBy(id_col).limit(sample).select(F.lit(i).alias("seq"), id_col, "ProjectCode")
        firsts = t if firsts is None else firsts.unionByName(t)
    codes = firsts.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct(id_col, "ProjectCode"))).alias("_c"))
    codes = codes.select("seq", F.transform("_c", lambda x: x["ProjectCode"]).alias("affected_projects"))
    meta = risk.sparkSession.createDataFrame(
        [(i, cat, sev, text, rec) for i, (cat, sev, text, rec) in enumerate(RECOMMENDATIONS)],
        "seq int, category string, severity string, finding_text string, recommendation string")
    out = F.broadcast(meta).join(counts, "seq").join(codes, "seq", "left")
    return out.where(F.col("count") > 0).select(
        "seq", "category", "severity",
        F.concat(F.col("count").cast("string"), F.lit(" "), F.col("finding_text")).alias("finding"),
        "recommendation", "count", "affected_projects")

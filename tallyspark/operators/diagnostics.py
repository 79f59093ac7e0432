"""Risk diagnostics (A22-A24) and chart data as tables.

Drawing is not built; every figure's data is a small result DataFrame.  All
quantiles come from one exact order-statistics pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.functions import ordered
from tallyspark.operators.risk import COMPONENTS

SCORES = ["TotalRiskScore"] + COMPONENTS


def component_stats(risk: DataFrame) -> DataFrame:
    """Per score column min, max, mean, std and % of projects above 50."""
    long_df = ordered.unpivot(risk, [], {c: c for c in SCORES})
    return long_df.groupBy(F.col("metric").alias("component")).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (F.count_if(F.col("value") > 50) / F.count(F.lit(1)) * 100).alias("pct_over_50"))


def threshold_counts(features: DataFrame) -> DataFrame:
    """One row of counts over the fixed thresholds (present columns only)."""
    cols = set(features.columns)
    aggs = []
    if "CostRevenueRatio" in cols:
        aggs += [F.avg("CostRevenueRatio").alias("cost_ratio_mean"),
                 F.count_if(F.col("CostRevenueRatio") > 0.7).alias("cost_ratio_over_0_7"),
                 F.count_if(F.col("CostRevenueRatio") > 0.9).alias("cost_ratio_over_0_9")]
    if "ProfitMargin" in cols:
        aggs += [F.count_if(F.col("ProfitMargin") < 0).alias("margin_below_0"),
                 F.count_if(F.col("ProfitMargin") < 10).alias("margin_below_10"),
                 F.avg("ProfitMargin").alias("margin_mean")]
    if "EfficiencyScore" in cols:
        aggs += [F.avg("EfficiencyScore").alias("efficiency_mean"),
                 F.stddev_samp("EfficiencyScore").alias("efficiency_std")]
    if "NumDepartments" in cols:
        aggs += [F.count_if(F.col("NumDepartments") > n).alias(f"departments_over_{n}") for n in (5, 7, 10)]
    out = features.agg(*aggs)
    if "EfficiencyScore" in cols:
        z = F.try_divide(F.col("EfficiencyScore") - F.col("_mu"), F.col("_sd"))
        st = features.agg(F.avg("EfficiencyScore").alias("_mu"), F.stddev_samp("EfficiencyScore").alias("_sd"))
        low = ordered.attach_scalars(features.select("EfficiencyScore"), st).agg(
            F.count_if(z < -1).alias("efficiency_z_below_minus_1"))
        out = ordered.attach_scalars(out, low)
    return out


# FIXED VALUES: columns, quantiles and names of the source's thresholds (the last entry: truncated to int).
SUGGESTED = [("CostRevenueRatio", 0.75, "cost_ratio_suggested", False),
             ("CostRevenueRatio", 0.90, "high_cost_ratio_suggested", False),
             ("NumDepartments", 0.75, "many_departments_suggested", True),
             ("NumDepartments", 0.90, "very_many_departments_suggested", True)]

CALIBRATED = [("CostRevenueRatio", 0.70, "cost_ratio_warning", False),
              ("CostRevenueRatio", 0.85, "cost_ratio_critical", False),
              ("ProfitMargin", 0.25, "low_margin_threshold", False),
              ("ProfitMargin", 0.10, "very_low_margin_threshold", False),
              ("EfficiencyScore", 0.25, "low_efficiency_threshold", False),
              ("EfficiencyScore", 0.10, "very_low_efficiency_threshold", False),
              ("NumDepartments", 0.75, "high_dept_count", True),
              ("NumDepartments", 0.90, "very_high_dept_count", True),
              ("NumTasks", 0.80, "high_task_count", False),
              ("WorkIntensityEarly", 0.20, "low_early_intensity", False),
              ("WorkIntensityEarly", 0.10, "very_low_early_intensity", False)]


def thresholds(features: DataFrame, table=SUGGESTED + CALIBRATED) -> DataFrame:
    """Suggested (p75/p90) and calibrated thresholds as (key, value) rows.

    Department counts are truncated to int, as the source reports them.
    """
    rows = [t for t in table if t[0] in features.columns]
    if not rows:
        return features.sparkSession.createDataFrame([], "key string, value double")
    probs: dict[str, list[float]] = {}
    for c, p, _, _ in rows:
        probs.setdefault(c, [])
        if p not in probs[c]:
            probs[c].append(p)
    q = ordered.quantiles(features, probs)
    spec = features.sparkSession.createDataFrame(
        [(c, float(p), k, trunc) for c, p, k, trunc in rows], "metric string, p double, key string, trunc boolean")
    j = F.broadcast(spec).join(q, ["metric", "p"], "left")
    return j.select("key", F.when(F.col("trunc"), F.floor("q").cast("double")).otherwise(F.col("q")).alias("value"))


def score_histogram(risk: DataFrame, column: str = "TotalRiskScore", bins: int = 20) -> DataFrame:
    """Equal-width histogram between min and max (max in the last bin), zeros kept."""
    mm = risk.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    g = ordered.attach_scalars(risk.select(column), mm)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width * bins), F.lit(bins - 1)) + 1) \
         .otherwise(F.lit(1))
    counts = g.where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = mm.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_lo", "_hi")
    out = grid.join(counts, "bin", "left")
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select("bin", (F.col("_lo") + (F.col("bin") - 1) * w).alias("lo"),
                      (F.col("_lo") + F.col("bin") * w).alias("hi"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def component_means(risk: DataFrame) -> DataFrame:
    """Mean of each component, largest first."""
    return ordered.unpivot(risk, [], {c: c for c in COMPONENTS}).groupBy(
        F.col("metric").alias("component")).agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"))


def level_shares(risk: DataFrame) -> DataFrame:
    """Share of each risk level in percent (of projects with a level)."""
    from tallyspark.operators.risk import level_histogram
    h = level_histogram(risk)
    tot = h.agg(F.sum("count").alias("_n"))
    return ordered.attach_scalars(h, tot).select(
        "RiskLevel", "count", F.try_divide(F.col("count") * 100.0, F.col("_n")).alias("share"))


SCATTER_PAIRS = [("CostRevenueRatio", "FinancialRisk"), ("EfficiencyScore", "EfficiencyRisk"),
                 ("NumDepartments", "ComplexityRisk")]


def scatter_pairs(features: DataFrame, risk: DataFrame, key: str = "row_id") -> DataFrame:
    """(pair, x, y) points for the three feature-vs-risk plots present."""
    j = features.join(risk.select(key, *COMPONENTS), key)
    pairs = [(x, y) for x, y in SCATTER_PAIRS if x in j.columns]
    structs = [F.struct(F.lit(f"{x}:{y}").alias("pair"), F.col(x).cast("double").alias("x"),
                        F.col(y).cast("double").alias("y")) for x, y in pairs]
    return j.select(key, F.explode(F.array(*structs)).alias("s")).select(key, "s.pair", "s.x", "s.y")

"""Financial reporting: labor cost, profit, margins, department metrics.

Plan shape: the work-hour fact is aggregated once per project (hours,
distinct departments, task count and labor cost in a single ``groupBy`` with
map-side partial aggregation), then left-joined to the project dimension on
``ProjectCode``.  The salary lookup is a ``create_map`` literal, so there is
no join for it at all.  Money totals are summed as DECIMAL so the result does
not depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.functions import ordered
from tallyspark.functions.exprs import clip, guarded_ratio, round_half_even, salary_of

MONEY = "decimal(38,10)"


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum of a double column (via DECIMAL), back to double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY)).cast("double")


def project_work(work_hours: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """A1 + A2: per project TotalHours, NumDepartments, NumTasks, LaborCost.

    LaborCost = sum(Hours * salary) / hours-per-year; an unknown or NULL
    department costs the mean salary.  NULL codes are dropped (as a
    group-by on the code does).
    """
    wh = work_hours.where(F.col("ProjectCode").isNotNull())
    return wh.groupBy("ProjectCode").agg(
        F.sum("Hours").alias("TotalHours"),
        F.count_distinct("Department").alias("NumDepartments"),
        F.count("Task").alias("NumTasks"),
        (F.sum(F.col("Hours") * salary_of("Department", departments)) / config.WORK_HOURS_PER_YEAR)
        .alias("LaborCost"),
    )


def financial_summary(projects: DataFrame, work_hours: DataFrame,
                      departments: list[str] | None = None, work: DataFrame | None = None) -> DataFrame:
    """B1 (J1, J2, P12, P14): projects plus the ten financial columns; ``work``: the rows of ``project_work``, where the caller has them."""
    pw = project_work(work_hours, departments) if work is None else work
    s = projects.join(pw, "ProjectCode", "left")
    s = s.select(
        *[F.col(c) for c in projects.columns],
        F.coalesce("TotalHours", F.lit(0.0)).alias("TotalHours"),
        F.coalesce("NumDepartments", F.lit(0)).alias("NumDepartments"),
        F.coalesce("NumTasks", F.lit(0)).alias("NumTasks"),
        F.coalesce("LaborCost", F.lit(0.0)).alias("LaborCost"),
    )
    s = s.withColumn("TotalCost", F.col("PurchaseCost") + F.col("LaborCost"))
    s = s.withColumn("Profit", F.col("ContractPrice") - F.col("TotalCost"))
    s = s.withColumn("ProfitMargin", clip(
        F.when(F.col("ContractPrice") > 0, F.col("Profit") / F.col("ContractPrice") * 100).otherwise(F.lit(0.0)),
        -200.0, 200.0))
    s = s.withColumn("EfficiencyScore", guarded_ratio("Profit", "TotalHours"))
    s = s.withColumn("RevenuePerHour", guarded_ratio("ContractPrice", "TotalHours"))
    s = s.withColumn("CostPerHour", guarded_ratio("TotalCost", "TotalHours"))
    return s


FINANCIAL_MERGE_COLUMNS = ["Profit", "ProfitMargin", "TotalCost", "LaborCost", "EfficiencyScore", "TotalHours"]


def merge_financials(projects: DataFrame, summary: DataFrame, key: str = "row_id") -> DataFrame:
    """Projects plus the six financial columns used downstream."""
    return projects.join(summary.select(key, *FINANCIAL_MERGE_COLUMNS), key, "left")


def department_summary(work_hours: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """A3: per department hours, projects, tasks, salary, rate, cost, productivity."""
    wh = work_hours.where(F.col("Department").isNotNull())
    d = wh.groupBy("Department").agg(
        F.sum("Hours").alias("TotalHours"),
        F.count_distinct("ProjectCode").alias("NumProjects"),
        F.count("Task").alias("NumTasks"),
    )
    sal = salary_of("Department", departments)
    return d.select(
        "Department", "TotalHours", "NumProjects", "NumTasks",
        sal.alias("AverageSalary"),
        (sal / config.WORK_HOURS_PER_YEAR).alias("HourlyRate"),
        (F.col("TotalHours") * (sal / config.WORK_HOURS_PER_YEAR)).alias("TotalLaborCost"),
        F.try_divide("TotalHours", "NumProjects").alias("HoursPerProject"),
        F.try_divide("TotalHours", "NumTasks").alias("HoursPerTask"),
    )


def department_matrix(work_hours: DataFrame, departments: list[str]) -> DataFrame:
    """A4: project x department hours, missing cells 0.

    The pivot values are passed explicitly (no extra distinct job, fixed
    schema); it is one conditional-sum aggregation per project.
    """
    wh = work_hours.where(F.col("ProjectCode").isNotNull() & F.col("Department").isNotNull())
    return (wh.groupBy("ProjectCode").pivot("Department", departments).agg(F.sum("Hours"))
              .fillna(0.0, subset=departments))


def metrics_by(summary: DataFrame, metric: str, group_col: str, exclude_unknown: bool = False) -> DataFrame:
    """Mean, std, min, max, count of a metric per group, rounded to 2."""
    df = summary
    if exclude_unknown:
        df = df.where(F.col("Status") != "Unknown")          # P6
    df = df.where(F.col(group_col).isNotNull())
    m = F.col(metric)
    return df.groupBy(group_col).agg(
        round_half_even(F.avg(m), 2).alias("mean"),
        round_half_even(F.stddev_samp(m), 2).alias("std"),
        round_half_even(F.min(m), 2).alias("min"),
        round_half_even(F.max(m), 2).alias("max"),
        F.count(m).alias("count"),
    )


def efficiency_distribution(summary: DataFrame, metric: str = "EfficiencyScore") -> DataFrame:
    """Mean, median, std and p25/p50/p75/p90 of a metric (one row)."""
    q = ordered.quantile_row(summary, {metric: [0.25, 0.5, 0.75, 0.9]},
                             name=lambda m, p: f"p{int(round(p * 100))}")
    m = summary.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    return ordered.attach_scalars(m, q).select("mean", F.col("p50").alias("median"), "std", "p25", "p50", "p75", "p90")


def overall_profitability(summary: DataFrame) -> DataFrame:
    """Totals, weighted margin, counts of profitable / loss / break-even."""
    agg = summary.agg(
        exact_sum("ContractPrice").alias("total_revenue"),
        exact_sum("TotalCost").alias("total_cost"),
        exact_sum("Profit").alias("total_profit"),
        F.count_if(F.col("Profit") > 0).alias("profitable_projects_count"),
        F.count_if(F.col("Profit") < 0).alias("loss_making_projects_count"),
        F.count_if(F.col("Profit") == 0).alias("break_even_projects_count"),
    )
    return agg.select(
        "total_revenue", "total_cost", "total_profit",
        F.when(F.col("total_revenue") > 0, F.col("total_profit") / F.col("total_revenue") * 100)
         .otherwise(F.lit(0.0)).alias("average_profit_margin"),
        "profitable_projects_count", "loss_making_projects_count", "break_even_projects_count",
    )


def top_projects(summary: DataFrame, metric: str, n: int = 10, largest: bool = True,
                 columns: list[str] | None = None, order_key: str = "row_id") -> DataFrame:
    """Top / bottom n by a metric; ties keep source order (``order_key``).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: a per-task
    top-n and one n-row merge, no global sort.
    """
    cols = columns or ["ProjectCode", "ProjectName", metric, "Profit", "TotalHours"]
    m = F.col(metric)
    return (summary.where(m.isNotNull() & ~F.isnan(m))
                   .orderBy(m.desc() if largest else m.asc(), F.col(order_key).asc())
                   .limit(n).select(*cols))


def profitable_projects(summary: DataFrame, n: int = 20) -> DataFrame:
    """The n most profitable projects (Profit > 0)."""
    cols = ["ProjectCode", "ProjectName", "Profit", "ProfitMargin", "Status"]
    return top_projects(summary.where(F.col("Profit") > 0), "Profit", n, True, cols)


def loss_making_projects(summary: DataFrame, n: int = 20) -> DataFrame:
    """The n largest losses (Profit < 0)."""
    cols = ["ProjectCode", "ProjectName", "Profit", "ProfitMargin", "Status"]
    return top_projects(summary.where(F.col("Profit") < 0), "Profit", n, False, cols)


def efficiency_analysis(summary: DataFrame) -> dict[str, DataFrame]:
    """B2."""
    return {
        "top_efficient_projects": top_projects(summary, "EfficiencyScore", 10, True),
        "bottom_efficient_projects": top_projects(summary, "EfficiencyScore", 10, False),
        "efficiency_by_type": metrics_by(summary, "EfficiencyScore", "ProjectType"),
        "efficiency_by_status": metrics_by(summary, "EfficiencyScore", "Status", exclude_unknown=True),
        "efficiency_distribution": efficiency_distribution(summary),
    }


def profitability_analysis(summary: DataFrame) -> dict[str, DataFrame]:
    """B3."""
    return {
        "overall_metrics": overall_profitability(summary),
        "profitable_projects": profitable_projects(summary),
        "loss_making_projects": loss_making_projects(summary),
        "profit_by_type": metrics_by(summary, "Profit", "ProjectType"),
        "profit_margin_by_status": metrics_by(summary, "ProfitMargin", "Status", exclude_unknown=True),
    }

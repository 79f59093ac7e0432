"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each string runs on the pre-registered views (orders, lineitem, part, ...).
The domain tables are rebuilt here as CTEs straight from the SURVEY 7.1
mapping, so the oracle shares no code with the Spark plans.  Doubles are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from tallyspark import config

GS = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'GS' ELSE 'ISS' END"


def _salary_case(col: str = "Department") -> str:
    whens = " ".join(f"WHEN '{d}' THEN {float(s)}"
                     for d, (_, s) in zip(config.GIVEN_DEPARTMENTS, config.DEPARTMENT_SALARIES))
    avg = sum(s for _, s in config.DEPARTMENT_SALARIES) / len(config.DEPARTMENT_SALARIES)
    return f"(CASE {col} {whens} ELSE {avg} END)"


SALARY = _salary_case()

PROJ = f"""proj AS (
  SELECT o_orderkey AS row_id,
         CAST(o_orderkey + 1 AS BIGINT) AS row_no,
         ({GS}) || CAST(o_orderkey AS VARCHAR) AS ProjectCode,
         'Customer ' || CAST(o_custkey AS VARCHAR) || ' order ' || CAST(o_orderkey AS VARCHAR) AS ProjectName,
         ({GS}) AS ProjectType,
         CASE WHEN o_orderkey % 20 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS ContractPrice,
         CASE WHEN o_orderkey % 20 = 1 THEN CAST(0 AS DOUBLE)
              ELSE o_totalprice * (CASE WHEN o_orderkey % 50 = 3 THEN CAST(1.3 AS DOUBLE)
                                        ELSE CAST(10 + o_orderkey % 9 AS DOUBLE) / 20 END) END AS PurchaseCost,
         CASE WHEN ({GS}) = 'ISS' THEN 'Unknown'
              WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'Fail'
              WHEN o_orderstatus = 'F' THEN 'Success'
              WHEN o_orderstatus = 'P' THEN 'Negotiation'
              WHEN o_orderstatus = 'O' THEN 'In Progress'
              ELSE 'Unknown' END AS Status
  FROM orders),
proj_c AS (
  SELECT *, CASE WHEN ProjectType = 'ISS' THEN NULL
                 WHEN Status = 'Success' THEN 'Green'
                 WHEN Status = 'Negotiation' THEN 'Dark Green'
                 WHEN Status = 'In Progress' THEN 'White'
                 WHEN Status = 'Fail' THEN 'Yellow' END AS ColorCode
  FROM proj)"""


def _md(d: str) -> str:
    return f"CAST(month({d}) AS VARCHAR) || '/' || CAST(day({d}) AS VARCHAR)"


WH = f"""wh0 AS (
  SELECT {_md('l.l_shipdate')} || '-' || {_md("(l.l_shipdate + INTERVAL 4 DAY)")} AS Date,
         ({GS.replace('o_orderpriority', 'o.o_orderpriority')}) || CAST(l.l_orderkey AS VARCHAR) || ' ' || p.p_name AS Project,
         l.l_linestatus AS Stage,
         p.p_brand AS Department,
         p.p_name AS Task,
         CAST(l.l_quantity AS DOUBLE) AS Hours
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey),
wh AS (
  SELECT *, nullif(regexp_extract(Project, '{config.PROJECT_CODE_PATTERN}', 1), '') AS ProjectCode FROM wh0)"""

PW = f"""pw AS (
  SELECT ProjectCode, sum(Hours) AS TotalHours, count(DISTINCT Department) AS NumDepartments,
         count(Task) AS NumTasks, sum(Hours * {SALARY}) / {config.WORK_HOURS_PER_YEAR} AS LaborCost
  FROM wh WHERE ProjectCode IS NOT NULL GROUP BY ProjectCode)"""

FS = f"""fs0 AS (
  SELECT p.row_id, p.row_no, p.ProjectCode, p.ProjectName, p.ProjectType, p.ContractPrice, p.PurchaseCost,
         p.Status, p.ColorCode,
         coalesce(w.TotalHours, 0) AS TotalHours, coalesce(w.NumDepartments, 0) AS NumDepartments,
         coalesce(w.NumTasks, 0) AS NumTasks, coalesce(w.LaborCost, 0) AS LaborCost
  FROM proj_c p LEFT JOIN pw w ON p.ProjectCode = w.ProjectCode),
fs1 AS (SELECT *, PurchaseCost + LaborCost AS TotalCost FROM fs0),
fs2 AS (SELECT *, ContractPrice - TotalCost AS Profit FROM fs1),
fs AS (
  SELECT *,
         least(greatest(CASE WHEN ContractPrice > 0 THEN Profit / ContractPrice * 100 ELSE 0 END, -200), 200) AS ProfitMargin,
         CASE WHEN TotalHours > 0 THEN Profit / TotalHours ELSE 0 END AS EfficiencyScore,
         CASE WHEN TotalHours > 0 THEN ContractPrice / TotalHours ELSE 0 END AS RevenuePerHour,
         CASE WHEN TotalHours > 0 THEN TotalCost / TotalHours ELSE 0 END AS CostPerHour
  FROM fs2)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(PROJ, WH, PW, FS)


def r(col: str, alias: str | None = None, d: int = config.OUTPUT_DECIMALS) -> str:
    return f"(round(CAST({col} AS DOUBLE), {d}) + 0.0) AS {q(alias or col)}"


def q(name: str) -> str:
    return f'"{name}"' if not name.isidentifier() else name


def rnd(cols: list[str]) -> str:
    return ", ".join(r(c) for c in cols)


FIN_COLS_D = ["ContractPrice", "PurchaseCost", "TotalHours", "LaborCost", "TotalCost", "Profit",
              "ProfitMargin", "EfficiencyScore", "RevenuePerHour", "CostPerHour"]


def _metrics_by(metric: str, group: str, exclude_unknown: bool) -> str:
    where = f"WHERE {group} IS NOT NULL" + (" AND Status <> 'Unknown'" if exclude_unknown else "")
    return BASE + f"""SELECT {group}, round_even(avg({metric}), 2) AS mean, round_even(stddev_samp({metric}), 2) AS std,
  round_even(min({metric}), 2) AS min, round_even(max({metric}), 2) AS max, count({metric}) AS count
FROM fs {where} GROUP BY {group}"""


def _top(metric: str, n: int, largest: bool, cols: list[str], where: str = "") -> str:
    dcols = [c for c in cols if c not in ("ProjectCode", "ProjectName", "Status")]
    plain = [c for c in cols if c in ("ProjectCode", "ProjectName", "Status")]
    order = "DESC" if largest else "ASC"
    cond = f"WHERE {metric} IS NOT NULL AND NOT isnan({metric})" + (f" AND {where}" if where else "")
    return BASE + f"""SELECT {', '.join(plain)}, {rnd(dcols)} FROM (
  SELECT * FROM fs {cond} ORDER BY {metric} {order}, row_id LIMIT {n})"""


def finance_sql(departments_all: list[str]) -> dict[str, str]:
    q: dict[str, str] = {}
    q["project_work"] = BASE + f"SELECT ProjectCode, {rnd(['TotalHours', 'LaborCost'])}, NumDepartments, NumTasks FROM pw"
    q["financial_summary"] = BASE + (
        "SELECT row_id, row_no, ProjectCode, ProjectName, ProjectType, Status, ColorCode, NumDepartments, NumTasks, "
        + rnd(FIN_COLS_D) + " FROM fs")
    q["department_summary"] = BASE + f"""SELECT Department, {r('TotalHours')}, NumProjects, NumTasks,
  {r('sal', 'AverageSalary')}, {r('sal / 2080', 'HourlyRate')}, {r('TotalHours * (sal / 2080)', 'TotalLaborCost')},
  {r('TotalHours / NumProjects', 'HoursPerProject')}, {r('TotalHours / NumTasks', 'HoursPerTask')}
FROM (SELECT Department, sum(Hours) AS TotalHours, count(DISTINCT ProjectCode) AS NumProjects,
             count(Task) AS NumTasks, any_value({SALARY}) AS sal
      FROM wh WHERE Department IS NOT NULL GROUP BY Department)"""
    pivots = ", ".join(
        f"round(CAST(coalesce(sum(CASE WHEN Department = '{d}' THEN Hours END), 0) AS DOUBLE), 6) AS \"{d}\""
        for d in departments_all)
    q["department_matrix"] = BASE + f"""SELECT ProjectCode, {pivots} FROM wh
WHERE ProjectCode IS NOT NULL AND Department IS NOT NULL GROUP BY ProjectCode"""
    q["efficiency_by_type"] = _metrics_by("EfficiencyScore", "ProjectType", False)
    q["efficiency_by_status"] = _metrics_by("EfficiencyScore", "Status", True)
    q["profit_by_type"] = _metrics_by("Profit", "ProjectType", False)
    q["profit_margin_by_status"] = _metrics_by("ProfitMargin", "Status", True)
    q["efficiency_distribution"] = BASE + f"""SELECT {r('avg(EfficiencyScore)', 'mean')},
  {r('quantile_cont(EfficiencyScore, 0.5)', 'median')}, {r('stddev_samp(EfficiencyScore)', 'std')},
  {r('quantile_cont(EfficiencyScore, 0.25)', 'p25')}, {r('quantile_cont(EfficiencyScore, 0.5)', 'p50')},
  {r('quantile_cont(EfficiencyScore, 0.75)', 'p75')}, {r('quantile_cont(EfficiencyScore, 0.9)', 'p90')} FROM fs"""
    money = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"
    q["overall_profitability"] = BASE + f"""SELECT {r('rev', 'total_revenue')}, {r('cost', 'total_cost')},
  {r('prof', 'total_profit')},
  {r('CASE WHEN rev > 0 THEN prof / rev * 100 ELSE 0 END', 'average_profit_margin')},
  pc AS profitable_projects_count, lc AS loss_making_projects_count, bc AS break_even_projects_count
FROM (SELECT {money('ContractPrice')} AS rev, {money('TotalCost')} AS cost, {money('Profit')} AS prof,
             count_if(Profit > 0) AS pc, count_if(Profit < 0) AS lc, count_if(Profit = 0) AS bc FROM fs)"""
    tcols = ["ProjectCode", "ProjectName", "EfficiencyScore", "Profit", "TotalHours"]
    q["top_efficient_projects"] = _top("EfficiencyScore", 10, True, tcols)
    q["bottom_efficient_projects"] = _top("EfficiencyScore", 10, False, tcols)
    pcols = ["ProjectCode", "ProjectName", "Profit", "ProfitMargin", "Status"]
    q["profitable_projects"] = _top("Profit", 20, True, pcols, "Profit > 0")
    q["loss_making_projects"] = _top("Profit", 20, False, pcols, "Profit < 0")
    return q


# ---------------------------------------------------------------------------
# Features (B4-B8)
# ---------------------------------------------------------------------------

def _z(x: str, y: str) -> str:
    """X / (y with 0 replaced by 1)."""
    return f"({x}) / (CASE WHEN ({y}) = 0 THEN 1 ELSE ({y}) END)"


FEATURE_INT_COLS = {"row_id", "row_no", "Hours_count", "Department_nunique", "Department_count", "Task_nunique",
                    "IsGS", "Success", "ProjectDuration", "RevenuePerHour_IsExtreme", "CostPerHour_IsExtreme",
                    "WorkConcentration_IsExtreme", "UnusualCostRatio"}
FEATURE_STR_COLS = {"ProjectCode", "ProjectName", "ProjectType", "Status", "ColorCode"}


def feature_columns(keys: list[str], windows=config.TIME_WINDOWS) -> list[str]:
    cols = ["row_id", "row_no", "ProjectCode", "ProjectName", "ProjectType", "ContractPrice", "PurchaseCost",
            "Status", "ColorCode", "Profit", "ProfitMargin", "TotalCost", "LaborCost", "EfficiencyScore",
            "TotalHours", "Hours_sum", "Hours_mean", "Hours_std", "Hours_max", "Hours_min", "Hours_count",
            "Department_nunique", "Department_count", "Task_nunique", "CostRevenueRatio", "RevenuePerHour",
            "CostPerHour", "IsGS", "Success", "ProjectDuration"]
    cols += [f"Hours_First_{n}_Days" for n in windows]
    cols += ["WorkIntensityEarly", "WorkAcceleration", "DepartmentDiversity"]
    for k in keys:
        cols += [f"{k}_Hours", f"{k}_Proportion"]
    cols += ["AvgDeptPerPeriod", "TasksPerHour", "HoursPerDepartment", "WorkConcentration", "WorkVariability",
             "MarginPotential"]
    for c in ["RevenuePerHour", "CostPerHour", "WorkConcentration"]:
        cols += [f"{c}_ZScore", f"{c}_IsExtreme"]
    cols += ["UnusualCostRatio", "ComplexityScore"]
    return cols


def feature_ctes(keys: list[str], windows=config.TIME_WINDOWS) -> list[str]:
    w0, w1 = windows[0], windows[1]
    first = ",\n         ".join(
        f"coalesce(sum(CASE WHEN w.DateStart <= d.d0 + {n} THEN w.h END), 0) AS Hours_First_{n}_Days"
        for n in windows)
    keyh = ", ".join(f'sum(CASE WHEN Department = \'{k}\' THEN dh END) AS "{k}_Hours"' for k in keys)
    keyp = ",\n         ".join(
        f'coalesce("{k}_Hours", 0) AS "{k}_Hours", {_z(f"coalesce(\"{k}_Hours\", 0)", "Hours_sum")} AS "{k}_Proportion"'
        for k in keys)
    keys_excl = ", ".join(f'"{k}_Hours"' for k in keys)
    return [
        """proj_f AS (
  SELECT p.*, f.Profit, f.ProfitMargin, f.TotalCost, f.LaborCost, f.EfficiencyScore, f.TotalHours
  FROM proj_c p LEFT JOIN fs f ON p.row_id = f.row_id)""",
        """whd AS (SELECT *, CAST(try_strptime('1900/' || split_part(Date, '-', 1), '%Y/%m/%d') AS DATE) AS DateStart
  FROM wh WHERE ProjectCode IS NOT NULL)""",
        """base AS (
  SELECT ProjectCode, sum(Hours) AS Hours_sum, avg(Hours) AS Hours_mean, stddev_samp(Hours) AS Hours_std,
         max(Hours) AS Hours_max, min(Hours) AS Hours_min, count(Hours) AS Hours_count,
         count(DISTINCT Department) AS Department_nunique, count(Department) AS Department_count,
         count(DISTINCT Task) AS Task_nunique
  FROM wh WHERE ProjectCode IS NOT NULL GROUP BY ProjectCode)""",
        """daily AS (SELECT ProjectCode, DateStart, sum(Hours) AS h FROM whd GROUP BY ProjectCode, DateStart)""",
        """dd AS (SELECT ProjectCode, min(DateStart) AS d0, max(DateStart) AS d1 FROM daily GROUP BY ProjectCode)""",
        f"""tl AS (
  SELECT w.ProjectCode, CAST(any_value(date_diff('day', d.d0, d.d1)) AS INTEGER) AS ProjectDuration,
         {first}
  FROM daily w JOIN dd d ON w.ProjectCode = d.ProjectCode GROUP BY w.ProjectCode)""",
        """dm AS (
  SELECT ProjectCode, Department, sum(Hours) AS dh FROM wh
  WHERE ProjectCode IS NOT NULL AND Department IS NOT NULL GROUP BY ProjectCode, Department)""",
        """dm2 AS (SELECT *, sum(dh) OVER (PARTITION BY ProjectCode) AS tot FROM dm)""",
        f"""mix AS (
  SELECT ProjectCode,
         -coalesce(sum(CASE WHEN tot <> 0 THEN (dh / tot) * log2(dh / tot + 1e-10) END), 0) AS DepartmentDiversity,
         {keyh}
  FROM dm2 GROUP BY ProjectCode)""",
        """co AS (
  SELECT ProjectCode, avg(nd) AS AvgDeptPerPeriod FROM (
    SELECT ProjectCode, Date, count(DISTINCT Department) AS nd FROM wh
    WHERE ProjectCode IS NOT NULL AND Date IS NOT NULL GROUP BY ProjectCode, Date) GROUP BY ProjectCode)""",
        f"""f1 AS (
  SELECT p.*, b.Hours_sum, b.Hours_mean, b.Hours_std, b.Hours_max, b.Hours_min, b.Hours_count,
         b.Department_nunique, b.Department_count, b.Task_nunique,
         {_z('p.PurchaseCost', 'p.ContractPrice')} AS CostRevenueRatio,
         {_z('p.ContractPrice', 'b.Hours_sum')} AS RevenuePerHour,
         {_z('p.PurchaseCost', 'b.Hours_sum')} AS CostPerHour,
         CAST(p.ProjectType = 'GS' AS INTEGER) AS IsGS,
         CASE p.Status WHEN 'Success' THEN 1 WHEN 'Negotiation' THEN 0 WHEN 'In Progress' THEN -1
                       WHEN 'Fail' THEN 0 WHEN 'Unknown' THEN -1 END AS Success,
         t.* EXCLUDE (ProjectCode), m.* EXCLUDE (ProjectCode), c.AvgDeptPerPeriod
  FROM proj_f p LEFT JOIN base b ON p.ProjectCode = b.ProjectCode
  LEFT JOIN tl t ON p.ProjectCode = t.ProjectCode
  LEFT JOIN mix m ON p.ProjectCode = m.ProjectCode
  LEFT JOIN co c ON p.ProjectCode = c.ProjectCode)""",
        f"""f2 AS (
  SELECT * EXCLUDE ({keys_excl}),
         {_z(f'Hours_First_{w0}_Days', 'Hours_sum')} AS WorkIntensityEarly,
         (Hours_First_{w1}_Days - Hours_First_{w0}_Days) / 7 AS WorkAcceleration,
         {keyp},
         {_z('Task_nunique', 'Hours_sum')} AS TasksPerHour,
         {_z('Hours_sum', 'Department_nunique')} AS HoursPerDepartment,
         {_z('Hours_max', 'Hours_mean')} AS WorkConcentration,
         {_z('Hours_std', 'Hours_mean')} AS WorkVariability,
         1 - CostRevenueRatio AS MarginPotential
  FROM f1)""",
        """st AS (
  SELECT avg(RevenuePerHour) AS mu1, stddev_samp(RevenuePerHour) AS sd1,
         avg(CostPerHour) AS mu2, stddev_samp(CostPerHour) AS sd2,
         avg(WorkConcentration) AS mu3, stddev_samp(WorkConcentration) AS sd3,
         quantile_cont(CostRevenueRatio, 0.5) AS crr_med FROM f2)""",
        f"""feat AS (
  SELECT f2.*,
         (RevenuePerHour - mu1) / nullif(sd1, 0) AS RevenuePerHour_ZScore,
         CAST(coalesce(abs((RevenuePerHour - mu1) / nullif(sd1, 0)) > {config.EFFICIENCY_ZSCORE}, false) AS INTEGER) AS RevenuePerHour_IsExtreme,
         (CostPerHour - mu2) / nullif(sd2, 0) AS CostPerHour_ZScore,
         CAST(coalesce(abs((CostPerHour - mu2) / nullif(sd2, 0)) > {config.EFFICIENCY_ZSCORE}, false) AS INTEGER) AS CostPerHour_IsExtreme,
         (WorkConcentration - mu3) / nullif(sd3, 0) AS WorkConcentration_ZScore,
         CAST(coalesce(abs((WorkConcentration - mu3) / nullif(sd3, 0)) > {config.EFFICIENCY_ZSCORE}, false) AS INTEGER) AS WorkConcentration_IsExtreme,
         CAST(coalesce(abs(CostRevenueRatio - crr_med) > {config.COST_VARIANCE}, false) AS INTEGER) AS UnusualCostRatio,
         {_z('Department_nunique * Task_nunique', 'Hours_sum')} AS ComplexityScore
  FROM f2, st)""",
    ]


FEAT_BASE = lambda keys: with_(PROJ, WH, PW, FS, *feature_ctes(keys))


def select_rounded(cols: list[str], src: str, int_cols=FEATURE_INT_COLS, str_cols=FEATURE_STR_COLS) -> str:
    parts = [q(c) if (c in int_cols or c in str_cols) else r(q(c), c) for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def features_sql(keys: list[str]) -> dict[str, str]:
    base = FEAT_BASE(keys)
    out = {}
    out["features"] = base + select_rounded(feature_columns(keys), "feat")
    out["features_incremental"] = out["features"]
    out["feature_base_aggregates"] = base + select_rounded(["ProjectCode"] + [
        "Hours_sum", "Hours_mean", "Hours_std", "Hours_max", "Hours_min", "Hours_count",
        "Department_nunique", "Department_count", "Task_nunique"], "base")
    out["feature_timeline"] = base + select_rounded(
        ["ProjectCode", "ProjectDuration"] + [f"Hours_First_{n}_Days" for n in config.TIME_WINDOWS], "tl")
    out["feature_department_mix"] = base + select_rounded(
        ["ProjectCode", "DepartmentDiversity"] + [f"{k}_Hours" for k in keys], "mix")
    out["feature_collaboration"] = base + select_rounded(["ProjectCode", "AvgDeptPerPeriod"], "co")
    return out


# ---------------------------------------------------------------------------
# Rule anomalies
# ---------------------------------------------------------------------------

def rules_sql(keys: list[str]) -> dict[str, str]:
    base = FEAT_BASE(keys)
    cost = f""", cr AS (SELECT feat.*, {_z('PurchaseCost', 'ContractPrice')} AS ratio FROM feat),
crm AS (SELECT quantile_cont(ratio, 0.5) AS med FROM cr),
cost_a AS (SELECT cr.*, 'cost' AS anomaly_type, ratio - med AS cost_ratio_deviation FROM cr, crm
           WHERE coalesce(abs(ratio - med) > {config.COST_VARIANCE}, false) OR coalesce(Profit < 0, false)),
eff_s AS (SELECT avg(TasksPerHour) AS mu, stddev_samp(TasksPerHour) AS sd FROM feat),
eff_a AS (SELECT feat.*, 'efficiency' AS anomaly_type, (TasksPerHour - mu) / nullif(sd, 0) AS efficiency_zscore
          FROM feat, eff_s WHERE abs((TasksPerHour - mu) / nullif(sd, 0)) > {config.EFFICIENCY_ZSCORE}),
pats AS (SELECT ProjectCode, list_sort(list_distinct(list(Department))) AS pat FROM wh
         WHERE ProjectCode IS NOT NULL GROUP BY ProjectCode),
pat_a AS (SELECT min(ProjectCode) AS ProjectCode, 'pattern' AS anomaly_type, pat FROM pats
          GROUP BY pat HAVING count(*) = 1)
"""
    b = base.rstrip("\n") + cost
    out = {}
    out["cost_anomalies"] = b + f"""SELECT row_id, ProjectCode, anomaly_type, {r('ratio', 'CostRevenueRatio')},
  {r('Profit')}, {r('cost_ratio_deviation')} FROM cost_a"""
    out["efficiency_anomalies"] = b + f"""SELECT row_id, ProjectCode, anomaly_type, {r('TasksPerHour')},
  {r('efficiency_zscore')} FROM eff_a"""
    out["anomaly_details"] = b + f"""SELECT ProjectCode, anomaly_type, {r('cost_ratio_deviation')},
  CAST(NULL AS DOUBLE) AS efficiency_zscore, CAST(NULL AS VARCHAR) AS department_pattern FROM cost_a
UNION ALL SELECT ProjectCode, anomaly_type, NULL, {r('efficiency_zscore')}, NULL FROM eff_a
UNION ALL SELECT ProjectCode, anomaly_type, NULL, NULL, array_to_string(pat, '|') FROM pat_a"""
    out["pattern_anomalies"] = b + "SELECT ProjectCode, anomaly_type, array_to_string(pat, '|') AS department_pattern FROM pat_a"
    out["anomaly_counts"] = b + """SELECT t.anomaly_type, coalesce(n, 0) AS count FROM
  (VALUES ('cost'), ('efficiency'), ('pattern')) t(anomaly_type) LEFT JOIN (
    SELECT anomaly_type, count(*) AS n FROM (
      SELECT anomaly_type FROM cost_a UNION ALL SELECT anomaly_type FROM eff_a
      UNION ALL SELECT anomaly_type FROM pat_a) GROUP BY anomaly_type) c ON t.anomaly_type = c.anomaly_type"""
    return out


# ---------------------------------------------------------------------------
# Risk scoring (B12-B17) and summaries
# ---------------------------------------------------------------------------

def _prank(expr: str, part: str) -> str:
    return (f"(CASE WHEN {part} IS NULL THEN NULL ELSE (rank() OVER (ORDER BY {expr}) + "
            f"(count(*) OVER (PARTITION BY {part}) - 1) / CAST(2 AS DOUBLE)) / count({part}) OVER () END)")


def risk_ctes(src: str, cols: set[str], mode: str = "percentile", flagged: str = "") -> list[str]:
    """CTEs ending in ``risk`` over the table ``src`` with columns ``cols``; ``flagged``: SQL of the row_ids with anomaly risk."""
    anomaly = f"(CASE WHEN row_id IN ({flagged}) THEN CAST(100 AS DOUBLE) ELSE 0 END)" if flagged else "CAST(0 AS DOUBLE)"
    med_cols = [c for c in ["CostRevenueRatio", "ProfitMargin", "RevenuePerHour", "EfficiencyScore",
                            "HoursPerTask", "NumDepartments", "NumTasks", "DepartmentDiversity",
                            "WorkIntensityEarly", "ProjectDuration"] if c in cols]
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in med_cols)
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS f_{c}" for c in med_cols)
    zfill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS f_{c}" for c in ["WorkVariability", "WorkAcceleration"]
                      if c in cols)
    ctes = [f"rmed AS (SELECT {meds} FROM {src})",
            f"rfil AS (SELECT {src}.*, {fills}{', ' + zfill if zfill else ''} FROM {src}, rmed)"]
    qs = []
    if "ProjectDuration" in cols:
        qs.append("quantile_cont(f_ProjectDuration, 0.75) AS q75_dur")
    if mode == "threshold":
        for c, p, nm in [("RevenuePerHour", 0.25, "q25_rph"), ("HoursPerTask", 0.75, "q75_hpt"),
                         ("NumTasks", 0.8, "q80_nt"), ("DepartmentDiversity", 0.1, "q10_div"),
                         ("DepartmentDiversity", 0.9, "q90_div")]:
            if c in cols:
                qs.append(f"quantile_cont(f_{c}, {p}) AS {nm}")
        if "EfficiencyScore" in cols:
            qs += ["avg(f_EfficiencyScore) AS eff_mu", "stddev_samp(f_EfficiencyScore) AS eff_sd"]
    ctes.append(f"rq AS (SELECT {', '.join(qs) if qs else '1 AS dummy'} FROM rfil)")
    ranks = []
    if mode == "percentile":
        for c, neg in [("CostRevenueRatio", False), ("ProfitMargin", True), ("RevenuePerHour", True),
                       ("EfficiencyScore", True), ("HoursPerTask", False), ("WorkVariability", False),
                       ("NumDepartments", False), ("NumTasks", False), ("DepartmentDiversity", False)]:
            if c in cols:
                key = f"round(f_{c}, 9)"
                ranks.append(f"{_prank(('-' if neg else '') + key, key)} AS r_{c}")
    ctes.append(f"rrk AS (SELECT rfil.*, rq.*{', ' + ', '.join(ranks) if ranks else ''} FROM rfil, rq)")

    def add(terms):
        return " + ".join(["CAST(0 AS DOUBLE)"] + terms)

    fin, eff, cx, tl = [], [], [], []
    if mode == "percentile":
        fin = [f"r_{c} * {w}" for c, w in [("CostRevenueRatio", 40), ("ProfitMargin", 30), ("RevenuePerHour", 30)]
               if c in cols]
        eff = [f"r_{c} * {w}" for c, w in [("EfficiencyScore", 40), ("HoursPerTask", 30), ("WorkVariability", 30)]
               if c in cols]
        cx = [f"r_{c} * {w}" for c, w in [("NumDepartments", 35), ("NumTasks", 35)] if c in cols]
        if "DepartmentDiversity" in cols:
            cx.append("abs(r_DepartmentDiversity - 0.5) * 2 * 30")
    else:
        if "CostRevenueRatio" in cols:
            fin.append("least(greatest((f_CostRevenueRatio - CAST(0.7 AS DOUBLE)) * 100, 0), 40)")
        if "ProfitMargin" in cols:
            fin.append("(CASE WHEN f_ProfitMargin < 0 THEN 40 WHEN f_ProfitMargin < 10 THEN 20 - f_ProfitMargin * 2 ELSE 0 END)")
        if "RevenuePerHour" in cols:
            fin.append("(CASE WHEN f_RevenuePerHour < q25_rph THEN 20 ELSE 0 END)")
        if "EfficiencyScore" in cols:
            z = "((f_EfficiencyScore - eff_mu) / eff_sd)"
            eff.append(f"(CASE WHEN {z} < -1 THEN 30 WHEN {z} < 0 THEN 15 ELSE 0 END)")
        if "HoursPerTask" in cols:
            eff.append("(CASE WHEN f_HoursPerTask > q75_hpt THEN 20 ELSE 0 END)")
        if "WorkVariability" in cols:
            eff.append("least(greatest(f_WorkVariability * 20, 0), 30)")
        if "NumDepartments" in cols:
            eff_nd = "(CASE WHEN f_NumDepartments > 10 THEN 30 WHEN f_NumDepartments > 7 THEN 20 WHEN f_NumDepartments > 5 THEN 10 ELSE 0 END)"
            cx.append(eff_nd)
        if "NumTasks" in cols:
            cx.append("(CASE WHEN f_NumTasks > q80_nt THEN 25 ELSE 0 END)")
        if "DepartmentDiversity" in cols:
            cx.append("(CASE WHEN f_DepartmentDiversity < q10_div OR f_DepartmentDiversity > q90_div THEN 25 ELSE 0 END)")
    if "WorkIntensityEarly" in cols:
        tl.append("(CASE WHEN f_WorkIntensityEarly < 0.1 THEN 30 WHEN f_WorkIntensityEarly < 0.2 THEN 15 ELSE 0 END)")
    if "WorkAcceleration" in cols:
        tl.append("(CASE WHEN f_WorkAcceleration < -5 THEN 25 WHEN f_WorkAcceleration < 0 THEN 10 ELSE 0 END)")
    if "ProjectDuration" in cols:
        tl.append("(CASE WHEN f_ProjectDuration > q75_dur THEN 20 ELSE 0 END)")
        tl.append("(CASE WHEN ProjectDuration IS NULL THEN 25 ELSE 0 END)")
    clipped = lambda e: f"least(greatest({e}, 0), 100)"
    ctes.append(f"""rcomp AS (
  SELECT row_id, ProjectCode, {clipped(add(fin))} AS FinancialRisk, {clipped(add(eff))} AS EfficiencyRisk,
         {clipped(add(cx))} AS ComplexityRisk, {clipped(add(tl))} AS TimelineRisk, {anomaly} AS AnomalyRisk
  FROM rrk)""")
    total = " + ".join(["CAST(0 AS DOUBLE)"] + [f"{c} * CAST({w} AS DOUBLE)" for c, w in config.RISK_WEIGHTS])
    levels = " ".join(f"WHEN t > {lo} AND t <= {hi} THEN '{nm}'" for nm, lo, hi in config.RISK_LEVELS)
    ctes.append(f"""risk AS (
  SELECT row_id, ProjectCode, t AS TotalRiskScore, FinancialRisk, EfficiencyRisk, ComplexityRisk, TimelineRisk,
         AnomalyRisk, CASE {levels} END AS RiskLevel, t > {config.HIGH_RISK_THRESHOLD} AS IsHighRisk
  FROM (SELECT *, {total} AS t FROM rcomp))""")
    return ctes


RISK_D = ["TotalRiskScore", "FinancialRisk", "EfficiencyRisk", "ComplexityRisk", "TimelineRisk", "AnomalyRisk"]


def _risk_select(src: str = "risk") -> str:
    return f"SELECT row_id, ProjectCode, {rnd(RISK_D)}, RiskLevel, IsHighRisk FROM {src}"


def risk_sql(keys: list[str]) -> dict[str, str]:
    fcols = set(feature_columns(keys))
    full_cte = """featx AS (SELECT feat.*, fs.NumDepartments, fs.NumTasks,
  CASE WHEN fs.NumTasks = 0 THEN NULL ELSE fs.TotalHours / fs.NumTasks END AS HoursPerTask
  FROM feat JOIN fs ON feat.row_id = fs.row_id)"""
    pipe = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *risk_ctes("feat", fcols))
    full = with_(PROJ, WH, PW, FS, *feature_ctes(keys), full_cte,
                 *risk_ctes("featx", fcols | {"NumDepartments", "NumTasks", "HoursPerTask"}))
    thr = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *risk_ctes("feat", fcols, "threshold"))
    thr_full = with_(PROJ, WH, PW, FS, *feature_ctes(keys), full_cte,
                     *risk_ctes("featx", fcols | {"NumDepartments", "NumTasks", "HoursPerTask"}, "threshold"))
    out = {"risk_scores": pipe + _risk_select(),
           "risk_scores_threshold_full": thr_full + _risk_select(),
           "risk_scores_full": full + _risk_select(),
           "risk_scores_threshold": thr + _risk_select()}
    comp_keys = ["financial", "efficiency", "complexity", "timeline", "anomaly"]
    means = ", ".join(f"avg({c}) AS {k}" for c, k in zip(RISK_D[1:], comp_keys))
    argmax = "CASE " + " ".join(
        f"WHEN {k} = greatest({', '.join(comp_keys)}) THEN '{k}'" for k in comp_keys) + " END"
    out["risk_summary"] = pipe + f"""SELECT total_projects, high_risk_count, {r('average_risk_score')},
  {rnd(comp_keys)}, {argmax} AS primary_risk_driver FROM (
  SELECT count(*) AS total_projects, count_if(IsHighRisk) AS high_risk_count,
         avg(TotalRiskScore) AS average_risk_score, {means} FROM risk)"""
    lv = ", ".join(f"('{nm}')" for nm, _, _ in config.RISK_LEVELS)
    out["risk_level_histogram"] = pipe + f"""SELECT l.RiskLevel, coalesce(n, 0) AS count FROM (VALUES {lv}) l(RiskLevel)
  LEFT JOIN (SELECT RiskLevel, count(*) AS n FROM risk WHERE RiskLevel IS NOT NULL GROUP BY RiskLevel) c
  ON l.RiskLevel = c.RiskLevel"""
    out["risk_by_type"] = pipe + f"""SELECT ProjectType, {r('avg(TotalRiskScore)', 'mean')},
  {r('stddev_samp(TotalRiskScore)', 'std')}, {r('min(TotalRiskScore)', 'min')}, {r('max(TotalRiskScore)', 'max')}
  FROM feat JOIN risk ON feat.ProjectCode = risk.ProjectCode GROUP BY ProjectType"""
    out["risk_levels_by_type"] = pipe + f"""SELECT t.ProjectType, l.RiskLevel, coalesce(n, 0) AS count
  FROM (SELECT DISTINCT ProjectType FROM feat JOIN risk ON feat.ProjectCode = risk.ProjectCode) t,
       (VALUES {lv}) l(RiskLevel)
  LEFT JOIN (SELECT ProjectType, RiskLevel, count(*) AS n FROM feat JOIN risk ON feat.ProjectCode = risk.ProjectCode
             WHERE RiskLevel IS NOT NULL GROUP BY ProjectType, RiskLevel) c
  ON t.ProjectType = c.ProjectType AND l.RiskLevel = c.RiskLevel"""
    by_type, levels = out["risk_by_type"][len(pipe):], out["risk_levels_by_type"][len(pipe):]
    out["risk_level_map_by_type"] = pipe + f"""SELECT a.*, b.RiskLevel FROM ({by_type}) a JOIN (
  SELECT ProjectType, string_agg(RiskLevel || ':' || CAST(count AS VARCHAR), ',' ORDER BY RiskLevel) AS RiskLevel
  FROM ({levels}) GROUP BY ProjectType) b ON a.ProjectType = b.ProjectType"""
    out["risk_by_status"] = pipe + f"""SELECT Status, {r('avg(TotalRiskScore)', 'mean')}, count(TotalRiskScore) AS count
  FROM feat JOIN risk ON feat.ProjectCode = risk.ProjectCode WHERE Status <> 'Unknown' GROUP BY Status"""
    comps = ["FinancialRisk", "EfficiencyRisk", "ComplexityRisk", "TimelineRisk", "AnomalyRisk"]
    tcomps = ", ".join(f"t.{c}" for c in comps)
    pf = "CASE " + " ".join(f"WHEN t.{c} = greatest({tcomps}) THEN '{c.replace('Risk', '')}'"
                            for c in comps) + " END"
    out["high_risk_projects"] = pipe + f"""SELECT t.row_id, t.ProjectCode, {', '.join(r('t.' + c, c) for c in RISK_D)},
  t.RiskLevel, t.IsHighRisk, p.ProjectName, p.ProjectType, {r('p.ContractPrice', 'ContractPrice')}, p.Status,
  {pf} AS PrimaryRiskFactor
  FROM (SELECT * FROM risk ORDER BY TotalRiskScore DESC, row_id LIMIT 15) t
  LEFT JOIN feat p ON t.ProjectCode = p.ProjectCode"""
    rules = ["FinancialRisk > 60", "ComplexityRisk > 60", "TimelineRisk > 60",
             "(FinancialRisk > 50 AND EfficiencyRisk > 50) OR (ComplexityRisk > 50 AND TimelineRisk > 50)"]
    texts = [("Financial Risk", "High", "projects with high financial risk", "Review cost estimation and pricing strategies"),
             ("Complexity Risk", "Medium", "projects with high complexity", "Consider breaking down into smaller phases or adding PM resources"),
             ("Timeline Risk", "Medium", "projects with timeline concerns", "Implement early-stage project acceleration protocols"),
             ("Multiple Risk Factors", "Critical", "projects with multiple high risk factors", "Immediate review and intervention required")]
    parts = []
    for i, (cond, (cat, sev, text, rec)) in enumerate(zip(rules, texts)):
        parts.append(f"""SELECT {i} AS seq, '{cat}' AS category, '{sev}' AS severity,
  CAST((SELECT count(*) FROM risk WHERE {cond}) AS VARCHAR) || ' {text}' AS finding, '{rec}' AS recommendation,
  (SELECT count(*) FROM risk WHERE {cond}) AS count,
  (SELECT string_agg(ProjectCode, ',' ORDER BY row_id) FROM
     (SELECT ProjectCode, row_id FROM risk WHERE {cond} ORDER BY row_id LIMIT 5)) AS affected_projects""")
    out["risk_recommendations"] = pipe + "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE count > 0"
    out["feature_pct_ranks"] = with_(PROJ, WH, PW, FS, *feature_ctes(keys)) + f"""SELECT row_id,
  {r(_prank('round(CostRevenueRatio, 9)', 'round(CostRevenueRatio, 9)'), 'CostRevenueRatio')},
  {r(_prank('-round(EfficiencyScore, 9)', 'round(EfficiencyScore, 9)'), 'EfficiencyScore')},
  {r(_prank('round(WorkVariability, 9)', 'round(WorkVariability, 9)'), 'WorkVariability')},
  {r(_prank('round(DepartmentDiversity, 9)', 'round(DepartmentDiversity, 9)'), 'DepartmentDiversity')} FROM feat"""
    return out


# ---------------------------------------------------------------------------
# Diagnostics
# ---------------------------------------------------------------------------

FULL_CTE = """featx AS (SELECT feat.*, fs.NumDepartments, fs.NumTasks,
  CASE WHEN fs.NumTasks = 0 THEN NULL ELSE fs.TotalHours / fs.NumTasks END AS HoursPerTask
  FROM feat JOIN fs ON feat.row_id = fs.row_id)"""


def diagnostics_sql(keys: list[str]) -> dict[str, str]:
    fcols = set(feature_columns(keys))
    pipe = with_(PROJ, WH, PW, FS, *feature_ctes(keys), FULL_CTE, *risk_ctes("feat", fcols))
    out = {}
    scores = ["TotalRiskScore", "FinancialRisk", "EfficiencyRisk", "ComplexityRisk", "TimelineRisk", "AnomalyRisk"]
    parts = [f"""SELECT '{c}' AS component, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')},
  {r(f'stddev_samp({c})', 'std')}, {r(f'count_if({c} > 50) / count(*) * 100', 'pct_over_50')} FROM risk"""
             for c in scores]
    out["risk_component_stats"] = pipe + "\nUNION ALL\n".join(parts)
    out["risk_threshold_counts"] = pipe + f"""SELECT {r('avg(CostRevenueRatio)', 'cost_ratio_mean')},
  count_if(CostRevenueRatio > 0.7) AS cost_ratio_over_0_7, count_if(CostRevenueRatio > 0.9) AS cost_ratio_over_0_9,
  count_if(ProfitMargin < 0) AS margin_below_0, count_if(ProfitMargin < 10) AS margin_below_10,
  {r('avg(ProfitMargin)', 'margin_mean')}, {r('avg(EfficiencyScore)', 'efficiency_mean')},
  {r('stddev_samp(EfficiencyScore)', 'efficiency_std')},
  count_if(NumDepartments > 5) AS departments_over_5, count_if(NumDepartments > 7) AS departments_over_7,
  count_if(NumDepartments > 10) AS departments_over_10,
  (SELECT count_if((EfficiencyScore - mu) / sd < -1) FROM featx,
     (SELECT avg(EfficiencyScore) AS mu, stddev_samp(EfficiencyScore) AS sd FROM featx)) AS efficiency_z_below_minus_1
  FROM featx"""
    quant = {"cost_ratio_suggested": "quantile_cont(CostRevenueRatio, 0.75)", "high_cost_ratio_suggested": "quantile_cont(CostRevenueRatio, 0.9)",
             "many_departments_suggested": "floor(quantile_cont(NumDepartments, 0.75))", "very_many_departments_suggested": "floor(quantile_cont(NumDepartments, 0.9))",
             "cost_ratio_warning": "quantile_cont(CostRevenueRatio, 0.7)", "cost_ratio_critical": "quantile_cont(CostRevenueRatio, 0.85)",
             "low_margin_threshold": "quantile_cont(ProfitMargin, 0.25)", "very_low_margin_threshold": "quantile_cont(ProfitMargin, 0.1)",
             "low_efficiency_threshold": "quantile_cont(EfficiencyScore, 0.25)", "very_low_efficiency_threshold": "quantile_cont(EfficiencyScore, 0.1)",
             "high_dept_count": "floor(quantile_cont(NumDepartments, 0.75))", "very_high_dept_count": "floor(quantile_cont(NumDepartments, 0.9))",
             "high_task_count": "quantile_cont(NumTasks, 0.8)", "low_early_intensity": "quantile_cont(WorkIntensityEarly, 0.2)",
             "very_low_early_intensity": "quantile_cont(WorkIntensityEarly, 0.1)"}
    parts = [f"SELECT '{k}' AS key, {r(e, 'value')} FROM featx" for k, e in quant.items()]
    out["risk_thresholds"] = pipe + "\nUNION ALL\n".join(parts)
    out["risk_histogram"] = pipe + f"""SELECT CAST(g.bin AS INTEGER) AS bin, {r('lo + (g.bin - 1) * ((hi - lo) / 20)', 'lo')},
  {r('lo + g.bin * ((hi - lo) / 20)', 'hi')}, coalesce(n, 0) AS count
FROM (SELECT unnest(range(1, 21)) AS bin) g CROSS JOIN (SELECT min(TotalRiskScore) AS lo, max(TotalRiskScore) AS hi FROM risk) m
LEFT JOIN (SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor((TotalRiskScore - lo) / (hi - lo) * 20), 19) + 1 ELSE 1 END AS INTEGER) AS b,
                  count(*) AS n
           FROM risk, (SELECT min(TotalRiskScore) AS lo, max(TotalRiskScore) AS hi FROM risk)
           WHERE TotalRiskScore IS NOT NULL GROUP BY b) c ON g.bin = c.b"""
    comps = scores[1:]
    out["risk_component_means"] = pipe + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS component, {r(f'avg({c})', 'mean')} FROM risk" for c in comps)
    lv = ", ".join(f"('{nm}')" for nm, _, _ in config.RISK_LEVELS)
    out["risk_level_shares"] = pipe + f"""SELECT RiskLevel, count, {r('count * 100.0 / sum(count) OVER ()', 'share')} FROM (
  SELECT l.RiskLevel, coalesce(n, 0) AS count FROM (VALUES {lv}) l(RiskLevel)
  LEFT JOIN (SELECT RiskLevel, count(*) AS n FROM risk WHERE RiskLevel IS NOT NULL GROUP BY RiskLevel) c
  ON l.RiskLevel = c.RiskLevel)"""
    out["risk_scatter_pairs"] = pipe + "\nUNION ALL\n".join(
        f"SELECT x.row_id, '{a}:{b}' AS pair, {r(f'x.{a}', 'x')}, {r(f'k.{b}', 'y')} FROM featx x JOIN risk k ON x.row_id = k.row_id"
        for a, b in [("CostRevenueRatio", "FinancialRisk"), ("EfficiencyScore", "EfficiencyRisk"),
                     ("NumDepartments", "ComplexityRisk")])
    return out


# ---------------------------------------------------------------------------
# Models with exact SQL equivalents (M1, M6 + M8, M11)
# ---------------------------------------------------------------------------

def _scale_ctes(src: str, cols: list[str], id_expr: str = "row_id", extra: list[str] | None = None, fitted: str = "true") -> list[str]:
    """``mx``: all rows of ``src``, filled and scaled by the statistics of those where ``fitted`` holds."""
    qc = [q(c) for c in cols]
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m{i}" for i, c in enumerate(qc))
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m{i}) AS v{i}" for i, c in enumerate(qc))
    mom = ", ".join(f"avg(v{i}) AS mu{i}, stddev_pop(v{i}) AS sd{i}" for i in range(len(cols)))
    sc = ", ".join(f"(v{i} - mu{i}) / (CASE WHEN sd{i} = 0 OR sd{i} IS NULL THEN 1 ELSE sd{i} END) AS {c}"
                   for i, c in enumerate(qc))
    ex = "".join(f", {e}" for e in (extra or []))
    return [f"mmed AS (SELECT {med} FROM {src} WHERE {fitted})",
            f"mfil AS (SELECT {id_expr} AS row_id{ex}, {fill} FROM {src}, mmed)",
            f"mmom AS (SELECT {mom} FROM mfil WHERE {fitted})",
            f"mx AS (SELECT row_id{ex}, {sc} FROM mfil, mmom)"]


def _lof_ctes(cols: list[str], k: int) -> list[str]:
    qc = [q(c) for c in cols]
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in qc)
    return [
        f"pr AS (SELECT a.row_id AS qid, b.row_id AS nid, sqrt({dist}) AS dist FROM mx a JOIN mx b ON a.row_id <> b.row_id)",
        f"nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rk FROM pr) WHERE rk <= {k})",
        "kd AS (SELECT qid AS nid, max(dist) AS kdist FROM nb GROUP BY qid)",
        "lrd AS (SELECT n.qid, 1.0 / (avg(greatest(k.kdist, n.dist)) + 1e-10) AS lrd FROM nb n JOIN kd k ON n.nid = k.nid GROUP BY n.qid)",
        "lofv AS (SELECT n.qid, avg(lo.lrd / lp.lrd) AS lof FROM nb n JOIN lrd lo ON n.nid = lo.qid JOIN lrd lp ON n.qid = lp.qid GROUP BY n.qid)",
        f"lthr AS (SELECT quantile_cont(-lof, {config.CONTAMINATION}) AS t FROM lofv)",
        "lofl AS (SELECT qid AS id, lof, -lof AS negative_outlier_factor, CASE WHEN -lof < t THEN -1 ELSE 1 END AS label FROM lofv, lthr)",
    ]


def _draw(key: str, salt: str, seed: int = 42) -> str:
    """The forest's draws: fifth powers modulo 2^31 - 1 (2147483647), spelled out."""
    fifth = lambda x: f"list_transform([{x}], lambda x: ((x * x % 2147483647) * (x * x % 2147483647) % 2147483647) * x % 2147483647)[1]"
    return fifth(f"({fifth(f'(({key}) % 2147483647 + 2147483647 + {seed}) % 2147483647')} * 48271 + ({salt}) * 69621 + 12345) % 2147483647")


def _forest_ctes(cols: list[str], fitted: str = "true", trees: int = 100, psi: int = 256, levels: int = 8) -> list[str]:
    """Isolation forest over ``mx``, grown level by level on the rows where ``fitted`` holds, and the scores of all rows.

    ift: rows of a tree and the node they are in; ifs: splits; iflf: nodes with their sizes; ifp: path lengths; ifo: offset;
    ifx (row_id, score, decision): the result.
    """
    vals = ", ".join(f"CAST(sign({q(c)}) * floor(abs({q(c)}) * 1e9 + 0.5) / 1e9 AS DOUBLE)" for c in cols)
    out = [f"ifv AS MATERIALIZED (SELECT row_id AS id, [{vals}] AS v, ({fitted}) AS fitted FROM mx)",
           "ifl AS MATERIALIZED (SELECT id, unnest(range(0, len(v))) AS f, unnest(v) AS x FROM ifv WHERE fitted)",
           f"""ift0 AS MATERIALIZED (SELECT t, id, CAST(1 AS BIGINT) AS node FROM (
  SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY {_draw('id', 't')}, id) AS k
  FROM ifv, (SELECT unnest(range(0, {trees})) AS t) WHERE fitted) WHERE k <= {psi})"""]
    for lev in range(levels):
        place = "t * 1000003 + node"
        out += [f"""ifr{lev} AS (SELECT t, node, f, min(x) AS lo, max(x) AS hi FROM ift{lev} JOIN ifl USING (id) GROUP BY t, node, f),
ifs{lev} AS MATERIALIZED (SELECT t, node, f, lo + {_draw(place, '2')} / CAST(2147483647 AS DOUBLE) * (hi - lo) AS thr
  FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY f) - 1 AS k, count(*) OVER (PARTITION BY t, node) AS m FROM ifr{lev} WHERE hi > lo)
  WHERE k = {_draw(place, '1')} * m // 2147483647)""",
                f"""ift{lev + 1} AS MATERIALIZED (SELECT t, id, 2 * node + CAST(x >= thr AS BIGINT) AS node
  FROM ift{lev} JOIN ifs{lev} USING (t, node) JOIN ifl USING (id, f))"""]
    out.append("ifs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ifs{lev}" for lev in range(levels)) + ")")
    out.append("iflf AS MATERIALIZED (SELECT t, node, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT t, node FROM ift{lev}" for lev in range(levels + 1)) + ") GROUP BY ALL)")
    out.append(f"ifw0 AS (SELECT id, t, CAST(1 AS BIGINT) AS node FROM ifv, (SELECT unnest(range(0, {trees})) AS t))")
    for lev in range(levels):
        out.append(f"""ifw{lev + 1} AS MATERIALIZED (SELECT w.id, w.t, CASE WHEN s.f IS NULL THEN w.node ELSE 2 * w.node + CAST(v[s.f + 1] >= s.thr AS BIGINT) END AS node
  FROM ifw{lev} w JOIN ifv USING (id) LEFT JOIN ifs s ON s.t = w.t AND s.node = w.node)""")
    c = lambda n: f"CASE WHEN {n} < 2 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) END"
    out.append(f"""ifp AS (SELECT id, avg(floor(log2(w.node)) + {c('l.n')}) AS h FROM ifw{levels} w JOIN iflf l ON l.t = w.t AND l.node = w.node GROUP BY id),
ifg AS MATERIALIZED (SELECT id AS row_id, fitted, round(-power(2, -h / ({c(f'least({psi}, (SELECT count(*) FROM ifv WHERE fitted))')})), 12) AS score FROM ifp JOIN ifv USING (id)),
ifx AS MATERIALIZED (SELECT row_id, fitted, score, score - (SELECT quantile_cont(score, 0.1) FROM ifg WHERE fitted) AS decision FROM ifg)""")
    return out


EMB_DIMS = 64


def _emb_src() -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIMS))
    return f"emb AS (SELECT vec_id AS row_id, label, {cols} FROM embeddings)"


def models_sql(keys: list[str], feature_cols: list[str]) -> dict[str, str]:
    out = {}
    base = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *_scale_ctes("feat", feature_cols))
    out["model_matrix"] = base + f"SELECT row_id, {', '.join(r(q(c), c) for c in feature_cols)} FROM mx"
    forest = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *_scale_ctes("feat", feature_cols), *_forest_ctes(sorted(feature_cols)))
    out["isolation_forest_scores"] = forest + f"SELECT row_id AS id, {r('score')}, {r('decision')}, CASE WHEN decision < 0 THEN -1 ELSE 1 END AS label FROM ifx"
    held = f"{_draw('row_id', '0', 7)} % 5 = 0"
    split = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *_scale_ctes("feat", feature_cols, fitted=f"NOT {held}"),
                  *_forest_ctes(sorted(feature_cols), f"NOT {_draw('mx.row_id', '0', 7)} % 5 = 0"))
    out["forest_check_new"] = split + f"SELECT row_id, {r('decision')}, decision < 0 AS is_anomaly FROM ifx WHERE NOT fitted"
    top = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {q(c)} AS val FROM mx" for c in feature_cols)
    out["forest_explanations"] = forest.rstrip("\n") + f""",
lg AS ({top}),
fst AS (SELECT feature, avg(val) AS mu, stddev_samp(val) AS sd FROM lg GROUP BY feature),
zz AS (SELECT lg.row_id, lg.feature, round((val - mu) / nullif(sd, 0), 9) AS z, decision FROM lg JOIN fst ON lg.feature = fst.feature
       JOIN ifx ON ifx.row_id = lg.row_id AND decision < 0),
tk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(z) DESC NULLS LAST, feature) AS rank FROM zz)
SELECT row_id, {r('decision', 'anomaly_score')}, CAST(rank AS INTEGER) AS rank, feature, {r('abs(z)', 'abs_z')}, {r('z')} FROM tk WHERE rank <= 5"""
    flagged = "SELECT row_id FROM ifx WHERE decision < 0"
    risky = forest.rstrip("\n") + ",\n" + ",\n".join(risk_ctes("feat", set(feature_columns(keys)), flagged=flagged)) + "\n"
    out["risk_scores_flagged"] = risky + _risk_select()
    out["project_lookup_flagged"] = risky + f"""SELECT f.row_id, f.ProjectCode, f.ProjectName, f.ProjectType, f.Status,
  {r('k.TotalRiskScore', 'TotalRiskScore')}, k.RiskLevel, {r('k.FinancialRisk', 'FinancialRisk')},
  {r('k.EfficiencyRisk', 'EfficiencyRisk')}, {r('k.ComplexityRisk', 'ComplexityRisk')},
  {r('k.TimelineRisk', 'TimelineRisk')}, {r('k.AnomalyRisk', 'AnomalyRisk')}, k.IsHighRisk, f.row_id IN ({flagged}) AS IsAnomaly,
  {r('f.ContractPrice', 'ContractPrice')}, {r('f.TotalCost', 'TotalCost')}, {r('f.Profit', 'Profit')}
  FROM feat f LEFT JOIN risk k ON f.row_id = k.row_id WHERE f.ProjectCode = (
    SELECT ProjectCode FROM feat JOIN ifx ON feat.row_id = ifx.row_id ORDER BY decision, feat.row_id LIMIT 1)"""
    ecols = [f"e{i}" for i in range(EMB_DIMS)]
    n_emb_k = config.N_NEIGHBORS
    emb = with_(_emb_src(), *_scale_ctes("emb", ecols), *_lof_ctes(ecols, n_emb_k))
    out["lof_embeddings"] = emb + f"SELECT id, {r('lof')}, {r('negative_outlier_factor')}, label FROM lofl"
    out["lof_embeddings_cells"] = out["lof_embeddings"]
    unpiv = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {c} AS val FROM mx" for c in ecols)
    out["anomaly_explanations"] = emb.rstrip("\n") + f""",
lg AS ({unpiv}),
fst AS (SELECT feature, avg(val) AS mu, stddev_samp(val) AS sd FROM lg GROUP BY feature),
zz AS (SELECT lg.row_id, lg.feature, (val - mu) / nullif(sd, 0) AS z FROM lg JOIN fst ON lg.feature = fst.feature
       WHERE lg.row_id IN (SELECT id FROM lofl WHERE label = -1)),
tk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(z) DESC NULLS LAST, feature) AS rank FROM zz)
SELECT row_id, CAST(rank AS INTEGER) AS rank, feature, {r('abs(z)', 'abs_z')}, {r('z')} FROM tk WHERE rank <= 5"""
    return out


# ---------------------------------------------------------------------------
# Imputation (A17, M3, M4) and feature selection
# ---------------------------------------------------------------------------

PF = """pf AS (
  SELECT p.*, coalesce(w.TotalHours, 0) AS TotalHours, CAST(coalesce(w.NumDepartments, 0) AS DOUBLE) AS NumDepartments,
         CAST(coalesce(w.NumTasks, 0) AS DOUBLE) AS NumTasks, CAST(p.ProjectType = 'GS' AS DOUBLE) AS IsGS,
         (p.ContractPrice > 0 AND p.PurchaseCost > 0) AS complete
  FROM proj_c p LEFT JOIN pw w ON p.ProjectCode = w.ProjectCode)"""


def impute_sql() -> dict[str, str]:
    base = with_(PROJ, WH, PW, PF)
    out = {}
    mean_ratio = "CAST(sum(CAST(PurchaseCost / ContractPrice AS DECIMAL(38,12))) AS DOUBLE) / count(*)"
    out["cost_ratio_by_type"] = base + f"""SELECT ProjectType, {r(mean_ratio, 'cost_ratio')}
  FROM pf WHERE complete GROUP BY ProjectType"""
    out["imputed_costs"] = base + f"""SELECT row_id, {r('ContractPrice * least(greatest(coalesce(cr.cost_ratio, 0.8) * (1 + (NumDepartments - md) * 0.02), 0.6), 0.95)', 'PurchaseCost_imputed')}
  FROM pf LEFT JOIN (SELECT ProjectType AS pt, {mean_ratio} AS cost_ratio FROM pf WHERE complete GROUP BY ProjectType) cr
    ON pf.ProjectType = cr.pt,
  (SELECT avg(NumDepartments) AS md FROM pf WHERE complete)
  WHERE NOT complete AND PurchaseCost <= 0"""
    out["median_fallback"] = base + f"""SELECT row_id, ProjectCode, {r("CASE WHEN ContractPrice <= 0 THEN coalesce(mc, 1000000) ELSE ContractPrice END", 'ContractPrice')},
  {r("CASE WHEN PurchaseCost <= 0 THEN coalesce(mp, 800000) ELSE PurchaseCost END", 'PurchaseCost')}
  FROM pf, (SELECT quantile_cont(ContractPrice, 0.5) AS mc, quantile_cont(PurchaseCost, 0.5) AS mp FROM pf WHERE complete)"""
    out["imputed_projects_median"] = out["median_fallback"]
    return out


def selection_sql(keys: list[str], feature_cols: list[str], bins: int = 10) -> dict[str, str]:
    lab = "feat_l AS (SELECT * FROM feat WHERE Success >= 0)"
    base = with_(PROJ, WH, PW, FS, *feature_ctes(keys), lab, *_scale_ctes("feat_l", feature_cols, extra=["Success"]))
    unpiv = " UNION ALL ".join(f"SELECT row_id, Success, '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS val FROM mx"
                               for c in feature_cols)
    lg = f"lg AS ({unpiv})"
    out = {}
    mi = base.rstrip("\n") + f""",
{lg},
rk AS (SELECT *, (rank() OVER (PARTITION BY feature ORDER BY round(val, 9))
                  + (count(*) OVER (PARTITION BY feature, round(val, 9)) - 1) / CAST(2 AS DOUBLE))
                 / count(*) OVER (PARTITION BY feature) AS pr FROM lg),
bn AS (SELECT feature, Success, CAST(least(ceil(pr * {bins}), {bins}) AS INTEGER) AS bin FROM rk),
jt AS (SELECT feature, bin, Success, count(*) AS nby FROM bn GROUP BY ALL),
pb AS (SELECT feature, bin, sum(nby) AS nb FROM jt GROUP BY ALL),
py AS (SELECT feature, Success, sum(nby) AS ny FROM jt GROUP BY ALL),
nn AS (SELECT feature, sum(nby) AS n FROM jt GROUP BY ALL)
SELECT jt.feature, {r('sum((nby / n) * ln((nby * n) / (nb * ny)))', 'score')}
FROM jt JOIN pb USING (feature, bin) JOIN py USING (feature, Success) JOIN nn USING (feature) GROUP BY jt.feature"""
    out["feature_mutual_information"] = mi
    out["selected_features_mi"] = f"SELECT * FROM ({mi}) ORDER BY score DESC NULLS LAST, feature LIMIT 20"
    psi = lambda n: (f"(CASE WHEN {n} <= 16 THEN coalesce(list_sum(list_transform(range(1, CAST({n} AS BIGINT)), lambda j: CAST(1 AS DOUBLE) / j)), 0)"
                     f" - 0.57721566490153286 ELSE ln({n}) - 1.0 / (2 * {n}) - 1.0 / (12.0 * {n} * {n}) + 1.0 / (120 * power({n}, 4))"
                     f" - 1.0 / (252 * power({n}, 6)) END)")
    near = base.rstrip("\n") + f""",
{lg},
pt AS (SELECT feature, Success AS y, CAST(round(val * 1000000000) AS BIGINT) AS v, count(*) OVER (PARTITION BY feature, Success) AS nc FROM lg),
sl AS MATERIALIZED (SELECT *, least(3, nc - 1) AS k, {', '.join(f'lag(v, {j}) OVER w AS g{j}, lead(v, {j}) OVER w AS d{j}' for j in (1, 2, 3))}
  FROM pt WHERE nc > 1 WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
rd AS (SELECT feature, v, nc, k, list_min(list_filter(CASE k WHEN 1 THEN [v - g1, d1 - v] WHEN 2 THEN [v - g2, v - g1 + d1 - v - least(v - g1, d1 - v), d2 - v]
    ELSE [v - g3, v - g2 + d1 - v - least(v - g2, d1 - v), v - g1 + d2 - v - least(v - g1, d2 - v), d3 - v] END, lambda x: x IS NOT NULL)) AS r FROM sl),
mc AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN greatest(r - 1, 0) PRECEDING AND greatest(r - 1, 0) FOLLOWING) AS m,
              count(*) OVER (PARTITION BY feature) AS n FROM rd)
SELECT feature, {r(f"greatest(avg({psi('n')}) + avg({psi('k')}) - avg({psi('nc')}) - avg({psi('m')}), 0)", 'score')} FROM mc GROUP BY feature"""
    out["feature_mutual_information_neighbours"] = near
    out["selected_features_neighbours"] = f"SELECT * FROM ({near}) ORDER BY score DESC NULLS LAST, feature LIMIT 20"
    fsql = base.rstrip("\n") + f""",
{lg},
per AS (SELECT feature, Success, count(*) AS nc, sum(val) AS sc, sum(val * val) AS qc FROM lg GROUP BY ALL),
tot AS (SELECT feature, sum(nc) AS n, sum(sc) AS s, sum(qc) AS ss, count(*) AS k, sum(sc * sc / nc) AS br FROM per GROUP BY feature),
fv AS (SELECT feature, ((br - s * s / n) / (k - 1)) / nullif(((ss - s * s / n) - (br - s * s / n)) / (n - k), 0) AS score FROM tot)
"""
    out["feature_anova_f"] = fsql + f"SELECT feature, {r('score')} FROM fv"
    out["selected_features_f"] = fsql + f"SELECT feature, {r('score')} FROM fv ORDER BY score DESC NULLS LAST, feature LIMIT 20"
    return out


# ---------------------------------------------------------------------------
# Sources (S1, P1-P5, J13) and reports
# ---------------------------------------------------------------------------

def _row_color_values() -> str:
    return ", ".join(f"({r}, '{c}')" for c, rows in config.GS_ROW_COLORS.items() for r in rows)


def sources_sql(keys: list[str]) -> dict[str, str]:
    out = {}
    out["work_hours"] = with_(PROJ, WH) + "SELECT Date, Project, Stage, Department, Task, Hours, ProjectCode FROM wh"
    status = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in config.COLOR_STATUS)
    out["gs_sheet_status"] = f"""WITH sheet AS (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS row_no, 'GS' || CAST(o_orderkey AS VARCHAR) AS ProjectCode,
         o_totalprice AS ContractPrice FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')),
rc AS (SELECT * FROM (VALUES {_row_color_values()}) t(row_no, Color))
SELECT s.row_no, s.ProjectCode, 'GS' AS ProjectType, coalesce(rc.Color, 'Unknown') AS ColorCode,
       coalesce(CASE rc.Color {status} END, 'Unknown') AS Status, {r('s.ContractPrice', 'ContractPrice')}
FROM sheet s LEFT JOIN rc ON s.row_no = rc.row_no"""
    out["sheet_work_hours"] = with_(PROJ, WH) + """SELECT Date, Project, Stage, Department, Task,
  CASE WHEN Hours > 49 THEN 0 ELSE Hours END AS Hours, ProjectCode FROM wh"""
    out["sheet_projects"] = f"""WITH sheet AS (
  SELECT *, o_orderpriority IN ('1-URGENT','2-HIGH') AS gs FROM orders),
nr AS (SELECT *, row_number() OVER (PARTITION BY gs ORDER BY o_orderkey) AS row_no FROM sheet),
rc AS (SELECT * FROM (VALUES {_row_color_values()}) t(row_no, Color))
SELECT (CASE WHEN gs THEN 'GS' ELSE 'ISS' END) || CAST(o_orderkey AS VARCHAR) AS ProjectCode, 'Customer ' || CAST(o_custkey AS VARCHAR) AS ProjectName,
       CASE WHEN gs THEN 'GS' ELSE 'ISS' END AS ProjectType,
       {r('CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE o_totalprice END', 'ContractPrice')}, {r('o_totalprice / 2', 'PurchaseCost')},
       CASE WHEN gs THEN coalesce(CASE rc.Color {status} END, 'Unknown') ELSE 'Unknown' END AS Status,
       CASE WHEN gs THEN coalesce(rc.Color, 'Unknown') END AS ColorCode, nr.row_no,
       nr.row_no + (CASE WHEN gs THEN 0 ELSE 1099511627776 END) AS row_id
FROM nr LEFT JOIN rc ON gs AND nr.row_no = rc.row_no WHERE o_orderkey % 50 <> 7"""
    names = [c for c in feature_columns(keys) if c not in ("ProjectCode", "ProjectType", "Status", "Success",
                                                           "row_id", "row_no")]
    out["feature_summary"] = with_(PROJ, WH, PW, FS, *feature_ctes(keys)) + f"""SELECT {len(names)} AS total_features,
  count(*) AS total_projects, '{",".join(names[:20])}' AS feature_names FROM feat"""
    fcols = set(feature_columns(keys))
    pipe = with_(PROJ, WH, PW, FS, *feature_ctes(keys), *risk_ctes("feat", fcols))
    out["project_lookup"] = pipe + f"""SELECT f.row_id, f.ProjectCode, f.ProjectName, f.ProjectType, f.Status,
  {r('k.TotalRiskScore', 'TotalRiskScore')}, k.RiskLevel, {r('k.FinancialRisk', 'FinancialRisk')},
  {r('k.EfficiencyRisk', 'EfficiencyRisk')}, {r('k.ComplexityRisk', 'ComplexityRisk')},
  {r('k.TimelineRisk', 'TimelineRisk')}, {r('k.AnomalyRisk', 'AnomalyRisk')}, k.IsHighRisk,
  {r('f.ContractPrice', 'ContractPrice')}, {r('f.TotalCost', 'TotalCost')}, {r('f.Profit', 'Profit')}
  FROM feat f LEFT JOIN risk k ON f.row_id = k.row_id WHERE f.ProjectCode = 'GS2'"""
    return out


def cast_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)`` (DuckDB returns HUGEINT)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1

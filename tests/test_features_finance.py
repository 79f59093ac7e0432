"""Financial metrics and features on hand-made work-hour / project fixtures."""
import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import features as feat
from tallyspark.operators import finance

WH = [  # Date, Project, Stage, Department, Task, Hours
    ("7/1-7/5", "GS1 alpha", "s", "IT部", "t1", 10.0),
    ("7/8", "GS1 alpha", "s", "设计部", "t2", 5.0),        # exactly 7 days after the first start
    ("7/9", "GS1 alpha", "s", "设计部", "t2", 4.0),        # 8 days: outside the 7-day window
    ("7/20", "GS1 alpha", "s", "unknown", "t3", 1.0),
    ("8/1", "GS2 beta", "s", "IT部", "t1", 3.0),           # one work row -> std NULL
    ("2/29", "GS3 gamma", "s", None, "t1", 0.0),           # bad date, null department, zero hours
    ("7/1", "no code", "s", "IT部", "t1", 99.0),           # dropped: no project code
]
PROJ = [  # row_id, ProjectCode, ProjectName, ProjectType, ContractPrice, PurchaseCost, Status, ColorCode
    (1, "GS1", "alpha", "GS", 1000.0, 600.0, "Success", "Green"),
    (2, "GS2", "beta", "GS", 0.0, 100.0, "Fail", "Yellow"),
    (3, "GS3", "gamma", "GS", 500.0, 0.0, "Negotiation", "Dark Green"),
    (4, "ISS4", "delta", "ISS", 200.0, 50.0, "Unknown", None),   # no work rows
]


@pytest.fixture(scope="module")
def frames(spark):
    from tallyspark.functions.exprs import extract_project_code
    wh = spark.createDataFrame(WH, "Date string, Project string, Stage string, Department string, Task string, "
                                   "Hours double").withColumn("ProjectCode", extract_project_code("Project"))
    p = spark.createDataFrame(PROJ, "row_id long, ProjectCode string, ProjectName string, ProjectType string, "
                                    "ContractPrice double, PurchaseCost double, Status string, ColorCode string")
    return wh, p


def test_financial_summary(spark, frames):
    wh, p = frames
    fs = {r["ProjectCode"]: r for r in finance.financial_summary(p, wh).collect()}
    g1 = fs["GS1"]
    assert g1["TotalHours"] == 20.0 and g1["NumDepartments"] == 3 and g1["NumTasks"] == 4
    exp_labor = (10 * 85000 + 9 * 90000 + 1 * 80500) / 2080
    assert math.isclose(g1["LaborCost"], exp_labor)
    assert math.isclose(g1["Profit"], 1000 - 600 - exp_labor)
    assert fs["GS2"]["ProfitMargin"] == 0.0                     # no price -> margin 0
    assert fs["GS3"]["EfficiencyScore"] == 0.0                  # zero hours -> 0
    assert fs["ISS4"]["TotalHours"] == 0.0 and fs["ISS4"]["LaborCost"] == 0.0


def test_features_edge_cases(spark, frames):
    wh, p = frames
    fs = finance.financial_summary(p, wh)
    f = {r["ProjectCode"]: r for r in feat.create_features(
        wh, finance.merge_financials(p, fs), ["IT部", "设计部"], checkpoint=False).collect()}
    g1 = f["GS1"]
    assert g1["Hours_First_7_Days"] == 15.0                     # inclusive bound
    assert g1["Hours_First_14_Days"] == 19.0 and g1["Hours_First_30_Days"] == 20.0
    assert g1["ProjectDuration"] == 19
    assert g1["AvgDeptPerPeriod"] == 1.0
    assert f["GS2"]["Hours_std"] is None                        # one row
    assert f["GS3"]["ProjectDuration"] is None and f["GS3"]["Hours_First_7_Days"] == 0.0
    assert f["GS3"]["DepartmentDiversity"] is None              # only a null department
    assert f["ISS4"]["Hours_sum"] is None and f["ISS4"]["IT部_Hours"] == 0.0
    assert f["ISS4"]["RevenuePerHour"] is None                  # no work rows -> null ratio
    assert f["GS2"]["DepartmentDiversity"] == pytest.approx(0.0, abs=1e-9)
    shares = [10 / 20, 9 / 20, 1 / 20]
    assert g1["DepartmentDiversity"] == pytest.approx(-sum(s * math.log2(s + 1e-10) for s in shares))
    assert g1["DepartmentDiversity"] <= math.log2(3)
    assert f["GS1"]["Hours_First_7_Days"] <= f["GS1"]["Hours_First_14_Days"] <= f["GS1"]["Hours_First_30_Days"]
    assert len(feat.numeric_feature_names(feat.create_features(
        wh, finance.merge_financials(p, fs), ["IT部", "设计部"], checkpoint=False))) > 30


def test_department_summary_unknown_rate(spark, frames):
    wh, _ = frames
    d = {r["Department"]: r for r in finance.department_summary(wh).collect()}
    assert d["unknown"]["AverageSalary"] == 80500.0
    assert d["IT部"]["NumProjects"] == 2                          # the no-code row is not a project
    assert None not in d


def test_top_projects_tie_order(spark):
    df = spark.createDataFrame([(3, "c", 5.0), (1, "a", 5.0), (2, "b", 7.0), (4, "d", None)],
                               "row_id long, ProjectCode string, m double")
    got = [r[0] for r in finance.top_projects(df.withColumn("ProjectName", F.lit("")).withColumn(
        "Profit", F.lit(0.0)).withColumn("TotalHours", F.lit(0.0)), "m", 3).collect()]
    assert got == ["b", "a", "c"]

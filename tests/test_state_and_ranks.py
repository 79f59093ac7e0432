"""One pass over the work rows, and order statistics whose results never hang on the sample that guides them."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import ordered
from tallyspark.operators import features as feat
from tallyspark.operators import finance

SCHEMA = "Date string, Department string, Task string, Hours double, ProjectCode string"


def work_rows(n=700, seed=3):
    rnd = random.Random(seed)
    out = [(rnd.choice(["7/1-7/5", "7/8", "7/20", "12/30", "2/29", "", None]), rnd.choice(["a", "b", "c", None]), rnd.choice(["t1", "t2", None]),
            rnd.choice([None, 0.0, 0.1, 2.5, -1.0, 8.0]), rnd.choice(["GS1", "GS1", *[f"GS{k}" for k in range(2, 60)], None])) for _ in range(n)]
    return out + [(None, None, None, None, "GS90"), ("7/1", "a", "t", None, "GS91"), ("7/1", None, None, 4.0, "GS92"), ("2/29", "a", "t", 0.0, "GS93")]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_project_state_is_what_the_operators_give(spark, batch):
    wh = spark.createDataFrame(work_rows(), SCHEMA).repartition(3).cache()
    keys = ["a", "c", "absent"]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)          # projects go over the ends of batches
    try:
        rows = feat.project_state(wh, keys, departments=["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r["ProjectCode"]: r.asDict() for r in rows}
    assert len(got) == len(rows)
    work = finance.project_work(wh, ["a", "b"]).withColumnsRenamed({"TotalHours": "Hours_sum", "NumDepartments": "Department_nunique", "NumTasks": "Task_count"})
    for want in (feat.base_aggregates(wh), feat.timeline(wh), feat.department_mix(wh, keys), feat.collaboration(wh), work):
        want = {r["ProjectCode"]: r.asDict() for r in want.collect()}
        for code, w in want.items():
            for c, v in w.items():
                g = got[code][c]
                assert g == v or (v is not None and g is not None and math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9)), (code, c, g, v)
    assert got["GS90"]["DepartmentDiversity"] is None and got["GS90"]["AvgDeptPerPeriod"] is None and got["GS90"]["Task_nunique"] == 0


def test_features_and_financials_read_the_work_rows_once(spark):
    from tallyspark.plans import registry
    f, summary = registry._features_and_summary(spark, "/root/testdata/sf0.001")
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_name" not in plan


def skewed(spark, n=4000):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(n), "few": rng.integers(0, 3, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
                        "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.exponential(size=n))})
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, few double, hot double, gaps double")


def test_results_do_not_hang_on_the_sample(spark, monkeypatch):
    pdf, sdf = skewed(spark)
    wrong = {"few": np.array([9.0]), "hot": np.array([-50.0, -40.0]), "gaps": np.zeros(0)}
    columns = ["few", "hot", "gaps"]
    names = dict(zip(columns, ("m0", "m1", "m2")))
    monkeypatch.setattr(ordered, "_sampled", lambda wide, cols: {names[c]: wrong[c] for c in columns})
    q = ordered.quantile_row(sdf, {c: [0.1, 0.5] for c in columns}).first()
    ranks = ordered.pct_ranks(sdf, "id", {c: c for c in columns}).toPandas().set_index("id").sort_index()
    for c in columns:
        assert abs(q[f"{c}_q10"] - pdf[c].quantile(0.1)) < 1e-12 and abs(q[f"{c}_q50"] - pdf[c].quantile(0.5)) < 1e-12
        assert (ranks[c] - pdf[c].rank(pct=True)).abs().max() < 1e-12 and (ranks[c].isna() == pdf[c].isna()).all()


def test_small_samples_still_give_exact_quantiles_and_ranks(spark, monkeypatch):
    pdf, sdf = skewed(spark)
    monkeypatch.setattr(ordered, "SAMPLE", 200)
    q = ordered.quantile_row(sdf, {c: [0.1, 0.25, 0.5, 0.9] for c in ("few", "hot", "gaps")}).first()
    for c in ("few", "hot", "gaps"):
        for p in (0.1, 0.25, 0.5, 0.9):
            assert abs(q[f"{c}_q{int(p * 100)}"] - pdf[c].quantile(p)) < 1e-12
    r = ordered.pct_ranks(sdf, "id", {"hot": "hot", "gaps": -F.col("gaps")}, partitions=16).toPandas().set_index("id").sort_index()
    want = pd.DataFrame({"hot": pdf["hot"].rank(pct=True), "gaps": (-pdf["gaps"]).rank(pct=True)})
    assert (r["hot"] - want["hot"]).abs().max() < 1e-12
    assert ((r["gaps"] - want["gaps"]).abs().fillna(0) < 1e-12).all() and (r["gaps"].isna() == want["gaps"].isna()).all()


def test_ranks_of_repeated_and_null_ids(spark):
    sdf = spark.createDataFrame([(1, 1.0), (1, 3.0), (None, 2.0), (2, None), (3, float("nan"))], "id long, x double")
    got = {r["id"]: r["x"] for r in ordered.pct_ranks(sdf, "id", {"x": "x"}).collect()}
    assert got == {1: 1.0, None: 2 / 3, 2: None, 3: None}


def test_scatter_pairs_rank_the_features_not_their_join(spark, tmp_path):
    """Repeated orders make repeated rows, which the join with the summary multiplies; the scores are those of the features."""
    from tallyspark.operators import risk
    from tallyspark.plans import registry
    src, out = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("lineitem", "part", "orders"):
        t = spark.read.parquet(f"{src}/{name}.parquet").limit(2000)
        (t.unionByName(t.where("o_orderkey % 7 = 0")) if name == "orders" else t).write.parquet(f"{out}/{name}.parquet")
    f = registry._features(spark, out)
    want = {r["row_id"]: r["FinancialRisk"] for r in risk.calculate_risk_scores(f).collect()}
    got = registry.queries()["risk_scatter_pairs"](spark, out).where("pair = 'CostRevenueRatio:FinancialRisk'")
    rows = got.collect()
    assert {r["row_id"] for r in rows} == set(want) and all(abs(r["y"] - want[r["row_id"]]) < 1e-5 for r in rows)

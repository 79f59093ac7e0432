"""Exact quantiles and average-tie percentile ranks vs pandas, incl. a hot value."""
import numpy as np
import pandas as pd

from tallyspark.functions import ordered


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 40, n).astype(float)            # many ties
    b = rng.normal(size=n)
    b[: n // 3] = 7.0                                     # one value holds a third of all rows
    c = rng.exponential(size=n)
    c[rng.random(n) < 0.1] = np.nan                       # NULLs
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c})
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, a double, b double, c double")
    return pdf, sdf


def test_quantiles_match_pandas(spark):
    pdf, sdf = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = ordered.quantile_row(sdf, {c: probs for c in "abc"}, partitions=5).collect()[0]
    for c in "abc":
        for p in probs:
            assert abs(q[f"{c}_q{int(round(p * 100))}"] - pdf[c].quantile(p)) < 1e-12


def test_pct_ranks_match_pandas(spark):
    pdf, sdf = _frame(spark)
    r = ordered.pct_ranks(sdf, "id", {"a": "a", "b": "b", "c": "c"}, partitions=7).toPandas()
    r = r.set_index("id").sort_index()
    for c in "abc":
        exp = pdf.set_index("id")[c].rank(pct=True)
        got = r[c]
        assert ((exp - got).abs().fillna(0) < 1e-12).all()
        assert (exp.isna() == got.isna()).all()


def test_quantile_of_empty_metric_is_null(spark):
    sdf = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    q = ordered.quantile_row(sdf, {"x": [0.5]}).collect()[0]
    assert q["x_q50"] is None

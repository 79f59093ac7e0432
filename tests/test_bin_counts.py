"""Bins by percentile rank, counted without a rank of a row, against pandas; few rows, ties, every number of bins."""
import numpy as np
import pandas as pd
import pytest

from tallyspark.functions import ordered


@pytest.mark.parametrize("n,bins", [(1, 10), (2, 10), (37, 10), (400, 10), (700, 100), (331, 7)])
def test_bin_counts_are_those_of_the_ranks(spark, n, bins):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"y": rng.integers(0, 3, n).astype("int32"), "far": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float),
                        "flat": np.full(n, 2.5), "zeros": np.where(rng.random(n) < 0.4, 0.0, rng.random(n))})
    cols = ["far", "ties", "flat", "zeros"]
    got = {(r["metric"], r["bin"], r["y"]): r["c"] for r in ordered.bin_counts(spark.createDataFrame(pdf), cols, bins, "y").collect()}
    want = {}
    for c in cols:
        at = np.minimum(np.ceil(pdf[c].rank(pct=True) * bins), bins).astype(int)
        for (b, y), m in pd.Series(1, index=range(n)).groupby([at, pdf.y]).sum().items():
            want[c, b, y] = m
    assert got == want


def test_no_rank_of_a_row_is_moved(spark, monkeypatch):
    monkeypatch.setattr(ordered, "pct_ranks", None)
    from tallyspark.operators import selection
    df = spark.createDataFrame([(i, i % 2, float(i % 2 * 10 + i % 7), 1.0) for i in range(200)], "row_id long, Success int, a double, b double")
    got = {r["feature"]: r["score"] for r in selection.mutual_information(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(np.log(2), abs=1e-9) and got["b"] == pytest.approx(0.0, abs=1e-12)

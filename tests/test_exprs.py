"""Scalar expressions against hand-made cases (FIXTURES.md)."""
import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions import exprs as X


def _col(spark, values, typ, fn):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_project_code_extraction(spark):
    got = _col(spark, ["GS240001-BJ01 design", "no code here", "ISS240002设计部 task", None, "x GS12 y ISS3"],
               "string", X.extract_project_code)
    assert got == ["GS240001-BJ01", None, "ISS240002设计部", None, "GS12"]


def test_numeric_coercion(spark):
    got = _col(spark, ["abc", "", " 3 ", "1.5d", "NaN", "2.5", None, "-4e1"], "string", X.coerce_numeric)
    assert got == [0.0, 0.0, 3.0, 0.0, 0.0, 2.5, 0.0, -40.0]


def test_month_day_parse(spark):
    got = _col(spark, ["7/1-7/5", "07/01", "2/29", "7/1 ", None, "13/1", "12/31"], "string", X.parse_month_day)
    assert got == [dt.date(1900, 7, 1), dt.date(1900, 7, 1), None, None, None, None, dt.date(1900, 12, 31)]


def test_risk_level_bins(spark):
    got = _col(spark, [0.0, 20.0, 20.1, 60.0, 60.5, 100.0, None], "double", X.risk_level)
    assert got == [None, "Very Low", "Low", "Medium", "High", "Critical", None]


def test_guarded_and_zero_as_one_ratios(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 2.0), (3.0, None)], "a double, b double")
    r = df.select(X.guarded_ratio("a", "b").alias("g"), X.ratio_zero_as_one("a", "b").alias("z")).collect()
    assert [x["g"] for x in r] == [0.0, 2.5, None, 0.0]
    assert [x["z"] for x in r] == [10.0, 2.5, None, None]


def test_clip_keeps_null(spark):
    got = _col(spark, [-300.0, 5.0, 300.0, None], "double", lambda c: X.clip(c, -200.0, 200.0))
    assert got == [-200.0, 5.0, 200.0, None]


def test_first_argmax_ties(spark):
    df = spark.createDataFrame([(1.0, 3.0, 3.0), (5.0, 5.0, 1.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(X.first_argmax(["a", "b", "c"], ["A", "B", "C"])).collect()]
    assert got == ["B", "A", "A"]


def test_salary_lookup_default(spark):
    df = spark.createDataFrame([("IT部",), ("unknown",), (None,)], "d string")
    got = [r[0] for r in df.select(X.salary_of("d")).collect()]
    assert got == [85000.0, 80500.0, 80500.0]


def test_round_half_up_matches_numpy_scaling(spark):
    got = _col(spark, [2910.4240625, -2910.4240625, 2.675, -1e-10], "double", lambda c: X.round_half_up(c, 6))
    assert got == [2910.424063, -2910.424063, 2.675, 0.0]

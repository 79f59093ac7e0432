"""Sheet-export readers (S1-S5) and sinks (K1, K2)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import sheets, sinks


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def test_project_sheet_colours_and_blank_codes(spark):
    d = tempfile.mkdtemp(prefix="tally-test-")
    gs = os.path.join(d, "gs.csv")
    lines = ["Project Code,Project Name,Contract Price,Purchase Cost,Extra"]
    for i in range(1, 131):
        code = "" if i == 3 else f"GS24{i:04d}"
        price = "abc" if i == 5 else str(1000 + i)
        lines.append(f"{code},name {i},{price},{500 + i},x")
    _write(gs, lines)
    assert sheets.read_project_sheet(spark, gs, "GS").count() == 129   # all rows unless a limit is passed
    df = sheets.read_project_sheet(spark, gs, "GS", max_rows=120)
    rows = {r["row_no"]: r for r in df.collect()}
    assert 3 not in rows and max(rows) == 120            # blank code dropped after numbering; then the limit
    assert rows[1]["Status"] == "Success" and rows[31]["Status"] == "Fail" and rows[27]["Status"] == "Negotiation"
    assert rows[24]["ColorCode"] == "White" and rows[5]["ContractPrice"] == 0.0
    iss = os.path.join(d, "iss.csv")
    _write(iss, ["a,b,c,d"] + [f"ISS{i},n,{i},{i}" for i in range(1, 200)])
    wh = os.path.join(d, "wh.csv")
    _write(wh, ["Date,Project,Stage,Department,Task,Hours", "7/1,GS1,S,D,t,1"])
    assert sheets.load_all(spark, wh, gs, iss)[2].count() == 199
    idf = sheets.load_all(spark, wh, gs, iss, iss_max_rows=148)[2]
    assert idf.count() == 148 and idf.where(F.col("Status") != "Unknown").count() == 0
    both = sheets.combine_projects(df, idf)
    assert both.count() == 119 + 148 and both.select("row_id").distinct().count() == 119 + 148


def test_row_numbers_leave_the_frame_alone(spark):
    d = tempfile.mkdtemp(prefix="tally-test-")
    p = os.path.join(d, "many.csv")
    _write(p, ["a"] + [str(i) for i in range(1, 20001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = spark.read.option("header", True).csv(p)
        for _ in range(2):
            got = sheets.with_row_numbers(df)
            assert df.columns == ["a"] and got.columns == ["a", "row_no"]
            assert got.where(F.col("a").cast("long") != F.col("row_no")).count() == 0
            assert got.count() == 20000 and df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    _write(os.path.join(d, "more.csv"), ["a", "1"])
    with pytest.raises(ValueError):
        sheets.with_row_numbers(spark.read.option("header", True).csv(d))


def test_rows_of_several_files_in_a_given_order(spark):
    d = tempfile.mkdtemp(prefix="tally-test-")
    sizes = {"b.csv": 4000, "a.csv": 1, "empty.csv": 0, "c.csv": 7000}
    start, order = 0, ["c.csv", "a.csv", "empty.csv", "b.csv"]
    for name in order:
        _write(os.path.join(d, name), ["a,_file"] + [f"{start + i},x" for i in range(1, sizes[name] + 1)])
        start += sizes[name]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        got = sheets.with_row_numbers(spark.read.option("header", True).csv(d).select("a"), files=order)
        assert got.where(F.col("a").cast("long") != F.col("row_no")).count() == 0 and got.count() == start
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        sheets.with_row_numbers(spark.read.option("header", True).csv(d), files=["a.csv"])


def test_export_keeps_the_order(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tally-test-"), "sheet")
    df = spark.range(0, 5000).select(F.col("id").alias("by"), F.concat(F.lit("GS"), F.when(F.col("id") != 10, F.col("id"))).alias("code"),
                                     F.lit("a, \"b\"").alias("name"), F.lit("1").alias("price"), F.lit("").alias("cost"))
    files = sheets.export_sheet(df.orderBy(F.desc("by")), path, "by", 4)
    assert len(files) == 4
    back = {r["row_no"]: r for r in sheets.read_project_sheet(spark, path, "ISS", files=files).collect()}
    assert len(back) == 4999 and 11 not in back
    assert all(r["ProjectCode"] == f"GS{n - 1}" and r["ProjectName"] == 'a, "b"' and r["PurchaseCost"] == 0.0 for n, r in back.items())


def test_work_hours_reader(spark):
    d = tempfile.mkdtemp(prefix="tally-test-")
    p = os.path.join(d, "wh.csv")
    _write(p, ["Date,Project,Stage,Department,Detailed Task,Work Hour",
               "7/1-7/5,GS240001-BJ01 设计,S1,IT部,t,3",
               "7/2,random text,S1,IT部,t,1.5d",
               "7/3,ISS240002,S2,设计部,t, 4 "])
    wh = sheets.read_work_hours(spark, p).collect()
    assert [r["ProjectCode"] for r in wh] == ["GS240001-BJ01", None, "ISS240002"]
    assert [r["Hours"] for r in wh] == [3.0, 0.0, 4.0]


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="tally-out-")
    df = spark.createDataFrame([(1, "a", 2.5)], "row_id long, ProjectCode string, TotalRiskScore double")
    paths = sinks.write_results({"risk": df}, d)
    assert spark.read.json(paths[0]).count() == 1
    p = sinks.write_project_analysis(df, d)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["row_id", "ProjectCode", "TotalRiskScore"]

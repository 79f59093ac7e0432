"""Merged states against the aggregates of all rows."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import features as feat
from tallyspark.operators import finance, work_state

SCHEMA = "Date string, Department string, Task string, Hours double, ProjectCode string"


def rows(n=900, seed=1):
    """A hot project with a third of all rows, equal hours, zero hours, null hours, dates, departments, tasks and codes."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        code = "GS1" if k % 3 == 0 else rnd.choice(["GS2", "GS3", "ISS4", None])
        hours = 7.3 if code == "GS2" else 0.0 if code == "ISS4" else rnd.choice([None, 0.1, 2.5, 8.0, 3.3333])
        out.append((rnd.choice(["7/1-7/5", "7/8", "12/30", "2/29", None]), rnd.choice(["IT部", "设计部", "x", None]),
                    rnd.choice(["t1", "t2", "t3", None]), hours, code))
    return out + [("7/1", "x", "t", 5.0, "GS5"), ("7/1", None, None, None, "GS6")]


@pytest.fixture(scope="module")
def work(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def table(df):
    return {r["ProjectCode"]: r.asDict() for r in df.collect()}


def merged(work, *cuts):
    part = F.pmod(F.xxhash64(*work.columns), F.lit(len(cuts)))
    return work_state.merge(*[work_state.work_state(work.where(part == k)) for k in cuts])


def test_base_aggregates_of_merged_states(spark, work):
    want, got = table(feat.base_aggregates(work)), table(work_state.base_aggregates(merged(work, 0, 1, 2)))
    assert set(want) == set(got)
    for code, w in want.items():
        for c, v in w.items():
            g = got[code][c]
            if isinstance(v, float) and g is not None:
                assert math.isclose(g, v, rel_tol=1e-12, abs_tol=1e-9), (code, c, g, v)
            else:
                assert g == v or (c == "Hours_sum" and not (g or v)), (code, c, g, v)
    assert got["GS2"]["Hours_std"] == 0.0 and got["GS5"]["Hours_std"] is None


def test_order_of_merging_is_no_matter(work):
    a, b, c = (work_state.work_state(work.where(F.pmod(F.xxhash64(*work.columns), F.lit(3)) == k)) for k in range(3))
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(work_state.merge(work_state.merge(a, b), c)) == key(work_state.merge(c, b, a)) == key(work_state.work_state(work))


def test_features_of_merged_states(spark, work):
    projects = spark.createDataFrame([(k, c, "n", c.rstrip("0123456789"), 1000.0 * k, 400.0, "Success", None)
                                      for k, c in enumerate(["GS1", "GS2", "GS3", "ISS4", "GS5", "GS6", "GS7"])],
                                     "row_id long, ProjectCode string, ProjectName string, ProjectType string, ContractPrice double, "
                                     "PurchaseCost double, Status string, ColorCode string")
    make = lambda wh, **a: feat.create_features(wh, finance.merge_financials(projects, finance.financial_summary(projects, wh)), ["IT部", "设计部"], checkpoint=False, **a)
    state = merged(work, 0, 1)
    cells = work_state.as_work_rows(state)
    want, got = table(make(work)), table(make(cells, base=work_state.base_aggregates(state)))
    for code, w in want.items():
        for c, v in w.items():
            g = got[code][c]
            assert (v is None or g is None) and (v or 0) == (g or 0) or (math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9) if isinstance(v, float) else g == v), (code, c, g, v)


def test_empty(spark):
    empty = work_state.work_state(spark.createDataFrame([], SCHEMA))
    assert work_state.base_aggregates(work_state.merge(empty, empty)).count() == 0

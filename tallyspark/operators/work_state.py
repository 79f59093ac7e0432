"""Mergeable state of the work-hour fact (A9-A14): the features of old and new rows without the old rows.

One table at the grain (project, department, date text, task) holds what all
per-project aggregates need: rows, rows with hours, the sum and the sum of squares of the
hours, their extremes.  Everything in it adds up (or takes the larger one), so states
of disjoint sets of rows merge by one ``groupBy`` with partial sums, and the
state of new rows is merged with a stored one instead of reading the old fact again.
Distinct departments and tasks are part of the grain, so no cell holds a set, and
a project with a third of all rows is many cells.

Hours are whole numbers of ``1 / UNITS``: sums and squares are exact in any order,
and the standard deviation of equal hours is exactly 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = 10_000
GRAIN = ["ProjectCode", "Department", "Date", "Task"]


def _summed(cells: DataFrame) -> DataFrame:
    big = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).cast("decimal(28,0)").alias(c)
    return cells.groupBy(*GRAIN).agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), big("s"), big("q"),
                                     F.max("hi").alias("hi"), F.min("lo").alias("lo"))


def work_state(work_hours: DataFrame) -> DataFrame:
    """The state of a set of work rows; rows without a project code belong to none and are left out, as in the features."""
    units = F.round(F.col("Hours") * UNITS).cast("long")
    cells = work_hours.where(F.col("ProjectCode").isNotNull()).select(
        *GRAIN, F.lit(1).cast("long").alias("rows"), F.when(F.col("Hours").isNotNull(), 1).otherwise(0).cast("long").alias("n"),
        units.cast("decimal(28,0)").alias("s"), (units.cast("decimal(19,0)") * units.cast("decimal(19,0)")).cast("decimal(28,0)").alias("q"),
        F.col("Hours").alias("hi"), F.col("Hours").alias("lo"))
    return _summed(cells)


def merge(*states: DataFrame) -> DataFrame:
    """The state of all rows that the states stand for (disjoint sets of rows)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return _summed(out)


def as_work_rows(state: DataFrame) -> DataFrame:
    """Work rows with the state's sums: a row per cell, which is all that sums of hours and distinct counts need (not counts of rows)."""
    return state.select(*GRAIN, (F.col("s").cast("double") / UNITS).alias("Hours"))


def base_sums(state: DataFrame) -> DataFrame:
    """A9 without its distinct counts, which ``features.project_state`` has of the state's rows too."""
    per = state.groupBy("ProjectCode").agg(
        F.sum("s").cast("decimal(19,0)").alias("s"), F.sum("q").cast("decimal(28,0)").alias("q"), F.sum("n").alias("n"),
        F.max("hi").alias("Hours_max"), F.min("lo").alias("Hours_min"),
        F.coalesce(F.sum(F.when(F.col("Department").isNotNull(), F.col("rows"))), F.lit(0).cast("long")).alias("Department_count"))
    total, n = F.col("s").cast("double") / UNITS, F.col("n")
    spread = (n.cast("decimal(10,0)") * F.col("q") - F.col("s") * F.col("s")).cast("double")      # exact before the cast
    std = F.when(n > 1, F.sqrt(spread / (n * (n - 1).cast("double"))) / UNITS)
    return per.select("ProjectCode", total.alias("Hours_sum"), F.when(n > 0, total / n).alias("Hours_mean"), std.alias("Hours_std"),
                      "Hours_max", "Hours_min", n.alias("Hours_count"), "Department_count")


def base_aggregates(state: DataFrame) -> DataFrame:
    """A9 from the state, with the columns of ``features.base_aggregates``."""
    found = state.groupBy("ProjectCode").agg(F.count_distinct("Department").alias("Department_nunique"), F.count_distinct("Task").alias("Task_nunique"))
    return base_sums(state).join(found, "ProjectCode").select("ProjectCode", "Hours_sum", "Hours_mean", "Hours_std", "Hours_max", "Hours_min", "Hours_count",
                                                              "Department_nunique", "Department_count", "Task_nunique")

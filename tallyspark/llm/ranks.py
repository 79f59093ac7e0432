"""Places of rows inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stage


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (from 0, by ``order``, nulls first) and ``size`` inside each ``group``; ``group`` is never null.

    Rows are dealt in slices by range of (group, order); rows that tie are
    dealt apart by their place in the input.  Slices are staged, so that both
    readings see the same ones.  A group that spans slices starts each of them
    at the sum of those before, of which there is one number a slice.
    """
    keys = [group, *order, "tie_"]
    sliced = df.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*keys)
    sliced = stage(sliced.withColumn("slice_", F.spark_partition_id()), name)
    sizes = sliced.groupBy(group, "slice_").agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "slice_", F.sum("n_").over(whole).alias("size"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(group, "slice_").orderBy(*order, "tie_")
    placed = sliced.join(starts, [group, "slice_"]).withColumn("pos", F.col("base_") + F.row_number().over(inside) - 1)
    return placed.drop("slice_", "base_", "tie_")

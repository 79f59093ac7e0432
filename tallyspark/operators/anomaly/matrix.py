"""M1: model matrix -- numeric features, median-imputed, standardised.

``fit_scaler`` returns a one-row DataFrame of per-column medians, means and
population standard deviations (0 -> 1), computed in one exact-quantile pass
and one aggregate; ``transform`` applies it to any frame with the same
columns (also to new rows, M10).  ``ml.feature.StandardScaler`` is not used
because it divides by the sample std.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import ordered
from tallyspark.session import cut_lineage


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    med = ordered.quantile_row(df, {c: [0.5] for c in cols}, name=lambda m, p: f"med__{m}")
    filled = ordered.attach_scalars(df.select(*cols), med).select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"med__{c}")).alias(c) for c in cols])
    mom = filled.agg(*[x for c in cols for x in (F.avg(c).alias(f"mu__{c}"), F.stddev_pop(c).alias(f"sd__{c}"))])
    return ordered.attach_scalars(med, mom)


def transform(df: DataFrame, cols: list[str], stats: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Impute with the fitted medians, subtract means, divide by std (0 -> 1)."""
    keep = keep or []
    g = ordered.attach_scalars(df.select(*keep, *cols), stats)
    out = []
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.col(f"med__{c}"))
        sd = F.col(f"sd__{c}")
        out.append(((x - F.col(f"mu__{c}")) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)).alias(c))
    return g.select(*keep, *out)


def prepare(df: DataFrame, cols: list[str], id_col: str = "row_id", target: str | None = None) -> DataFrame:
    """P10 + P11 + M1: drop rows with a negative target (if given), impute, scale."""
    if target and target in df.columns:
        df = df.where(F.col(target) >= 0)
    stats = cut_lineage(fit_scaler(df, cols))               # a row, read whenever the matrix is
    return transform(df, cols, stats, [id_col] + ([target] if target and target in df.columns else []))


def as_vector(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """(id, v array<double>) -- the form the model kernels consume."""
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))

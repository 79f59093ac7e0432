"""K1, K2: result sinks.

Each result set is written by the executors as its own dataset (JSON lines
for the result sets, CSV with header for the project mart); nothing is
gathered on the driver.  Writes overwrite, so a retried job is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: dict[str, DataFrame], out_dir: str) -> list[str]:
    """K1: one JSON dataset per result set under ``out_dir/<name>``."""
    paths = []
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").json(path)
        paths.append(path)
    return paths


def write_project_analysis(mart: DataFrame, out_dir: str, name: str = "project_analysis") -> str:
    """K2: the project mart as CSV with a header."""
    path = f"{out_dir.rstrip('/')}/{name}"
    mart.write.mode("overwrite").option("header", True).csv(path)
    return path

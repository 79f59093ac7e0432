"""Helpers shared by the operators: tables, staged Parquet, session set-up."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import ensure_checkpoint_dir, ship_package

_STAGED: list[tuple[SparkSession, str]] = []
_PATHS: dict[int, str] = {}


def prepare(spark: SparkSession) -> None:
    """Shared folder set and package on the executors; safe to call again."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, deleted when Python ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-{uuid.uuid4().hex}-{name}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back.

    Cuts lineage: a lost executor costs a reread, not a recomputation.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    drop_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[id(out._jdf)] = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote; only for frames that nothing will read again."""
    for df in staged:
        path = _PATHS.pop(id(df._jdf), None)
        if path:
            delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs, which it does when their plans are collected as garbage.

    A job with many stages would otherwise hold the disk of all of them to its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before Python does
            return


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def bucket_of(key: Column, salt: str, mod: int) -> Column:
    """crc32 of a key as text (with an optional salt) modulo ``mod``; null keys as empty text."""
    return F.crc32(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))) % mod

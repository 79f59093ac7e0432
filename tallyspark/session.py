"""SparkSession helpers.

The session is configured for AQE (runtime coalescing and skew-join
splitting), UTC time, and Arrow transfer for the few pandas UDF stages.
Lineage is cut with Parquet tables below ``spark.checkpoint.dir``; that
setting is read from the session and only filled in here when it is unset
(tests, local runs), never with a machine-local folder on a cluster.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster use the session the platform gives you."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tallyspark`` importable in the Python workers (pandas stages).

    Zips the package once per application and registers it with
    ``addPyFile``; Spark distributes it to every executor.
    """
    import zipfile

    import tallyspark
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(tallyspark.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-pkg-"), "tallyspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


#: Seconds of a write after which the shuffles it needed are worth giving back.
LONG = 4.0


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read back (survives executor loss).

    Compressed columns take a fraction of the disk of ``checkpoint()``, which writes whole rows as they are in
    memory, and a reader takes only the columns it needs.  A table that comes from here is not written again.
    """
    if getattr(df, "_staged", False):
        return df
    path, began = shared_folder(df.sparkSession, "stage"), time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - began > LONG:
        free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = True
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Give back the disk of shuffles that no table refers to any more, before the next ones are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that are written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

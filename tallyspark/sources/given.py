"""The domain tables built from the given TPC-H-like parquet tables.

``projects``   <- ``orders``: one project per order (``row_id = o_orderkey``).
``work_hours`` <- ``lineitem`` joined with ``part`` (department = brand,
task = part name) and ``orders`` (project type for the code prefix); one
work row per line item.

Missing prices and costs are planted by order-key residues so that the
imputation paths run; no row is dropped.  Only the columns a plan reads are
selected, so Parquet prunes the rest; joins are left to Catalyst/AQE (a side
is broadcast only under ``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.exprs import extract_project_code

_GS_PRIORITIES = ["1-URGENT", "2-HIGH"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _project_type(priority: str = "o_orderpriority"):
    return F.when(F.col(priority).isin(*_GS_PRIORITIES), F.lit("GS")).otherwise(F.lit("ISS"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ProjectCode, ProjectName, ProjectType, ContractPrice, PurchaseCost, Status, ColorCode (+ row_id, row_no)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    ptype = _project_type()
    ratio = F.when(k % 50 == 3, F.lit(1.3)).otherwise((F.lit(10) + k % 9).cast("double") / 20)
    status = (F.when(ptype == "ISS", F.lit("Unknown"))
               .when((F.col("o_orderstatus") == "F") & (k % 10 == 0), F.lit("Fail"))
               .when(F.col("o_orderstatus") == "F", F.lit("Success"))
               .when(F.col("o_orderstatus") == "P", F.lit("Negotiation"))
               .when(F.col("o_orderstatus") == "O", F.lit("In Progress"))
               .otherwise(F.lit("Unknown")))
    color = (F.when(ptype == "ISS", F.lit(None).cast("string"))
              .when(status == "Success", F.lit("Green"))
              .when(status == "Negotiation", F.lit("Dark Green"))
              .when(status == "In Progress", F.lit("White"))
              .when(status == "Fail", F.lit("Yellow")))
    return o.select(
        k.alias("row_id"),
        (k + 1).cast("bigint").alias("row_no"),
        F.concat(ptype, k.cast("string")).alias("ProjectCode"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" order "),
                 k.cast("string")).alias("ProjectName"),
        ptype.alias("ProjectType"),
        F.when(k % 20 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("ContractPrice"),
        F.when(k % 20 == 1, F.lit(0.0)).otherwise(F.col("o_totalprice") * ratio).alias("PurchaseCost"),
        status.alias("Status"),
        color.alias("ColorCode"),
    )


def _md(d):
    return F.concat(F.month(d).cast("string"), F.lit("/"), F.dayofmonth(d).cast("string"))


def work_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, Project, Stage, Department, Task, Hours, ProjectCode."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_linestatus")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = (li.join(pa, li.l_partkey == pa.p_partkey)
           .join(o, li.l_orderkey == o.o_orderkey))
    d = F.to_date("l_shipdate")
    code = F.concat(_project_type(), F.col("l_orderkey").cast("string"))
    out = j.select(
        F.concat(_md(d), F.lit("-"), _md(F.date_add(d, 4))).alias("Date"),
        F.concat(code, F.lit(" "), F.col("p_name")).alias("Project"),
        F.col("l_linestatus").alias("Stage"),
        F.col("p_brand").alias("Department"),
        F.col("p_name").alias("Task"),
        F.col("l_quantity").cast("double").alias("Hours"),
    )
    return out.withColumn("ProjectCode", extract_project_code("Project"))


def embedding_dims(spark: SparkSession, sf_dir: str) -> int:
    """The length that all vectors share; vectors of different lengths are an error."""
    size = F.size("embedding")
    r = table(spark, sf_dir, "embeddings").agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vectors of {r['lo']} to {r['hi']} entries")
    return r["hi"] or 0


def embeddings_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as wide double columns e0..e{d-1} (row_id = vec_id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label"),
                    *[F.col("embedding").getItem(i).cast("double").alias(c)
                      for i, c in enumerate(embedding_features(embedding_dims(spark, sf_dir)))])


def embedding_features(dims: int) -> list[str]:
    return [f"e{i}" for i in range(dims)]

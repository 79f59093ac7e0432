"""Readers for exported work-hour / project sheets (CSV, Parquet, JSON).

The workbook itself (a single-machine binary format) is not read; its sheets
are read from exports.  Columns are renamed *by position* (S4), numbers are
coerced leniently (P2), the GS sheet gets its colour / status by source row
number (P4, J13) and rows without a project code are dropped after numbering
(P5).  Row numbers come from the export when it carries them, otherwise from
the rows' places: an export may be one file or several in a given order, each
read in as many blocks as Spark's reader cuts it into; the rows of all blocks are
counted first, and a row's number is its place in its block plus the rows before.
``export_*`` write sheets the way these readers expect them.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.functions.exprs import coerce_numeric, extract_project_code
from tallyspark.sources import lookups

PROJECT_COLUMNS = ["ProjectCode", "ProjectName", "ProjectType", "ContractPrice", "PurchaseCost", "Status",
                   "ColorCode"]


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    r = spark.read
    if fmt == "csv":
        # every column as text: coercion is explicit (P2), no schema inference pass
        return r.option("header", True).option("inferSchema", False).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.format(fmt).load(path)


def rename_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep the first len(names) columns and rename them."""
    return df.select(*df.columns[:len(names)]).toDF(*names)


def with_row_numbers(df: DataFrame, col: str = "row_no", files: list[str] | None = None) -> DataFrame:
    """1-based source row numbers in file order, without gaps, for a frame that comes straight from a reader.

    ``files``: the names of the export's files in their order; without it there may be only one.
    ``monotonically_increasing_id`` ascends within a block (a contiguous part of one file), so a row's
    place is its distance from the block's least id; blocks, a row each, are counted and
    summed up in order of file and offset.
    """
    if col in df.columns:
        return df
    own = df.columns
    placed = df.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    present = sorted(path.rstrip("/").rsplit("/", 1)[-1] for path in df.inputFiles())
    if files is None and len(present) > 1:
        raise ValueError(f"an export of several files needs a {col} column or the order of its files")
    if files is not None and sorted(files) != present:
        raise ValueError(f"the order names {sorted(files)}, the export has {present}")
    nth = F.array_position(F.array(*[F.lit(quote(f)) for f in files]), F.col("_file")) if files else F.lit(1)
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_first"))
    before = Window.orderBy(nth, "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    out = placed.join(blocks, ["_file", "_block"])                  # a row per block, 128 MB each by default
    return out.select(*[F.col(f"`{c}`") for c in own], (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias(col))


def export_sheet(sheet: DataFrame, path: str, order: str, files: int, most_rows: int = 500_000) -> list[str]:
    """Write a sheet as CSV in ``files`` files, or more of about ``most_rows`` rows, by ranges of ``order``; returns their names in that order.

    Each file has its rows sorted, so the files in this order hold the sheet in order. One task sorts and writes a
    file, so their number grows with the rows.
    """
    files = max(files, -(-sheet.count() // most_rows))
    sheet.repartitionByRange(files, order).sortWithinPartitions(order).drop(order) \
        .write.option("header", True).option("emptyValue", "").csv(path)
    return sorted(p.rsplit("/", 1)[-1] for p in sheet.sparkSession.read.text(path).inputFiles())


def read_work_hours(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Date, Project, Stage, Department, Task, Hours (double, bad -> 0), ProjectCode."""
    df = rename_by_position(_read(spark, path, fmt), config.WORK_HOURS_COLUMNS)
    return (df.withColumn("Hours", coerce_numeric("Hours", 0.0))
              .withColumn("ProjectCode", extract_project_code("Project")))


def shape_projects(sheet: DataFrame, project_type: str, max_rows: int | None) -> DataFrame:
    """P2-P5 on a sheet that carries ``row_no``: cap, literals, colours, drop blank codes."""
    df = sheet
    if max_rows is not None:
        df = df.where(F.col("row_no") <= max_rows)                  # source row cap (nrows)
    df = df.withColumn("ProjectType", F.lit(project_type))          # P3
    if project_type == "GS":
        spark = df.sparkSession
        colors = F.broadcast(lookups.row_color(spark))              # 120 rows
        status = F.broadcast(lookups.color_status(spark))           # 4 rows
        df = (df.join(colors, "row_no", "left").join(status, "Color", "left")
                .withColumn("ColorCode", F.coalesce("Color", F.lit("Unknown")))
                .withColumn("Status", F.coalesce("Status", F.lit("Unknown"))).drop("Color"))
    else:
        df = df.withColumn("ColorCode", F.lit(None).cast("string")).withColumn("Status", F.lit("Unknown"))
    df = df.where(F.col("ProjectCode").isNotNull())                  # P5 (after numbering)
    return (df.withColumn("ContractPrice", coerce_numeric("ContractPrice", 0.0))
              .withColumn("PurchaseCost", coerce_numeric("PurchaseCost", 0.0)))


def read_project_sheet(spark: SparkSession, path: str, project_type: str, fmt: str = "csv",
                       max_rows: int | None = None, files: list[str] | None = None) -> DataFrame:
    """A GS or ISS project sheet export; all rows, or source rows 1 to ``max_rows``; ``files`` as in ``with_row_numbers``."""
    raw = _read(spark, path, fmt)
    if "row_no" in raw.columns:
        body = [c for c in raw.columns if c != "row_no"][:len(config.PROJECT_SHEET_COLUMNS)]
        df = raw.select(*body, F.col("row_no").cast("long")).toDF(*config.PROJECT_SHEET_COLUMNS, "row_no")
    else:
        df = with_row_numbers(rename_by_position(raw, config.PROJECT_SHEET_COLUMNS), files=files)
    return shape_projects(df, project_type, max_rows)


def combine_projects(gs: DataFrame, iss: DataFrame) -> DataFrame:
    """Union of the two project sheets on the common columns (+ row ids)."""
    keep = PROJECT_COLUMNS + [c for c in ("row_no",) if c in gs.columns and c in iss.columns]
    out = gs.select(*keep).withColumn("_src", F.lit(0)).unionByName(iss.select(*keep).withColumn("_src", F.lit(1)))
    # row_id: unique across both sheets, stable (sheet, source row)
    return out.withColumn("row_id", F.col("_src") * F.lit(1 << 40) + F.col("row_no")).drop("_src")


def load_all(spark: SparkSession, work_hours_path: str, gs_path: str, iss_path: str,
             fmt: str = "csv", gs_max_rows: int | None = None, iss_max_rows: int | None = None,
             gs_files: list[str] | None = None, iss_files: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(work_hours, gs_projects, iss_projects) -- lazy plans, nothing read yet; all rows unless limited."""
    return (read_work_hours(spark, work_hours_path, fmt),
            read_project_sheet(spark, gs_path, "GS", fmt, gs_max_rows, gs_files),
            read_project_sheet(spark, iss_path, "ISS", fmt, iss_max_rows, iss_files))

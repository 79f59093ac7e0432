"""Steps whose memory, disk or copies must not grow faster than their rows."""
import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators.anomaly import iforest, knn
from tallyspark.session import cut_lineage
from tallyspark.sources import sheets


def frame(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, X)], "id long, v array<double>")


def test_stage_tables_are_columns_written_once(spark):
    df = spark.range(1000).select("id", F.lit("x").alias("word"), F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("half"))
    staged = cut_lineage(df)
    assert staged.inputFiles() and all(f.endswith(".parquet") for f in staged.inputFiles())
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect())) and staged.dtypes == df.dtypes
    assert cut_lineage(staged).inputFiles() == staged.inputFiles()


def test_tiles_hold_a_bounded_number_of_rows():
    sizes = {c: 1 + c % 40 for c in range(2000)} | {2000: 5000}
    tiles = knn._tiles(sizes, 1000)
    first = [t for t, _ in tiles.values()]
    assert first == sorted(first) and tiles[2000][1] == 5
    shared = {}
    for c, (t, parts) in tiles.items():
        if parts == 1:
            shared[t] = shared.get(t, 0) + sizes[c]
    assert max(shared.values()) <= 1000 and len(shared) <= 2 * sum(sizes.values()) / 1000       # tiles grow with the rows, not with the cells


def test_exact_neighbours_of_equal_and_repeated_rows(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 3))
    X[50:120] = X[3]
    got = {}
    for r in knn.knn(frame(spark, np.vstack([X, X[:40]]), [*range(300), *range(40)]), 6, cell_size=8, block=12).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["nid"]))
    for i in range(0, 300, 7):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [n for _, n in sorted(got[i])] == list(np.lexsort((np.arange(300), d))[:6])


def test_recall_probe_stops_the_rounds(spark):
    X = np.random.default_rng(1).normal(size=(600, 4))
    vec = frame(spark, X)
    full = knn.exact_knn(vec, 5)
    lists = full.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist", "nid"))).alias("near"))
    assert knn._recall(vec, lists, 5, 1) == 1.0
    assert abs(knn._recall(vec, lists.select("qid", F.slice("near", 1, 3).alias("near")), 5, 1) - 0.6) < 1e-9


def test_sheets_of_more_rows_have_more_files(spark, tmp_path):
    sheet = spark.range(1000).select(F.concat(F.lit("GS"), "id").alias("code"), "id")
    names = sheets.export_sheet(sheet, str(tmp_path / "a"), "id", 2, most_rows=100)
    assert len(names) == 10
    assert len(sheets.export_sheet(sheet, str(tmp_path / "b"), "id", 2)) == 2
    rows = sheets.with_row_numbers(spark.read.option("header", True).csv(str(tmp_path / "a")), files=names).orderBy("row_no").collect()
    assert [r["code"] for r in rows] == [f"GS{i}" for i in range(1000)]


def test_pools_are_drawn_in_arrow_batches_as_the_columns_draw(spark):
    vec = spark.range(-40, 400).select("id", F.array(F.col("id").cast("double")).alias("v"))
    vec = vec.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, array(0D) AS v"))
    got = iforest._sampled(vec, 440, 4, 30, 42)
    for t in range(4):
        own = sorted(r["id"] for r in got.where(F.col("tree") == t).collect())
        want = vec.where("id IS NOT NULL").orderBy(iforest.draw(F.col("id"), F.lit(t), 42), "id").limit(30).collect()
        assert own == sorted(r["id"] for r in want)

"""Operator 3: held-out accuracy, the gradient, parts of long texts, and odd rows."""

import numpy as np

from tallyspark.llm import op03_quality as op3
from tallyspark.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = op3.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(t == p for t, _, p in held) / len(held) > 0.95
    good, bad = [s for t, s, _ in held if t], [s for t, s, _ in held if not t]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    spoilt = labels.withColumn("quality", F.when(op3.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in op3.quality(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in op3.quality(docs.withColumn("lang", F.lit("x")), spoilt).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_edge_rows(spark, make_docs):
    rows = [(i, ("good words stand in this text " * 9) if i % 2 else "*** !!! *** " * 20) for i in range(60)]
    docs = make_docs([*rows, (100, None), (101, ""), (101, " \n"), (None, "good words"), (102, "good words stand here " * 60_000)], extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 1), (3, 1, 1), (None, 1, 1)], LABELS)
    got = op3.quality(docs, labels.withColumn("text", labels["quality"])).collect()
    assert len(got) == 65
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > 0.8 and by[0] < 0.2 and by[102] > 0.5 and by[100] == by[101]
    assert op3.quality(make_docs([]), labels).count() == 0
    assert {r["score"] for r in op3.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in op3.quality(docs, labels.filter("quality = 1")).collect()} == {1.0}


def test_parts_score_like_the_whole(monkeypatch):
    rnd = np.random.default_rng(2)
    text = b" ".join(rnd.choice([b"alpha", b"beta,", b"GAMMA!!", b"42", b"***"], 5000))
    x, bag = op3.encode([b"alpha beta", b"*** !!!", text[:900]])
    model = op3.fit(x, bag, np.array([1.0, 0.0, 1.0]))
    whole = op3.score_texts(model, [text, b"", None])
    monkeypatch.setattr(op3, "GROUP_BYTES", 3000)
    monkeypatch.setattr(op3.in_parts, "__defaults__", (3000,))
    assert len(op3.in_parts(text)) > 5
    assert np.allclose(whole, op3.score_texts(model, [text, b"", None]))


def test_encoding_by_hand():
    x, bag = op3.encode([b"aa aa B.", b"", b"x " * 130])
    assert list(bag) == [0, 1, 2, 2, 2]
    assert np.isclose(x[0, op3.CLASSES], 1 / 3) and np.isclose(x[0, op3.CLASSES + 1], 2 / 3)
    assert not x[1].any() and np.isclose(x[4, op3.CLASSES + 7], 2 / 64)

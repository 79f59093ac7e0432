"""Operator 6: held-out accuracy, mixtures, and odd rows."""

import numpy as np

from tallyspark.llm import op06_language as op6
from tallyspark.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = dict(docs.select("doc_id", "lang").collect())
    got = [r for r in op6.identify(docs).collect()]
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and 150 < len(held) < 350
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    spoilt = docs.withColumn("lang", F.when(op6.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6.identify(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6.identify(spoilt).collect()}


def test_mixture_of_two(make_docs):
    one, two = "aba bab abba baab " * 60, "xyx yxy xyyx yxxy " * 60
    rows = [(i, t, lang) for i in range(40) for t, lang in [(one, "a")] if i % 2] + [(i, two, "x") for i in range(0, 40, 2)]
    rows += [(100, one[:300] + " " + two[:900]), (101, one + " x"), (102, None), (103, " 12 -- "), (104, ""), (None, one), (104, two), (105, one * 300)]
    got = {(r["doc_id"], r["lang_pred"]): r for r in op6.identify(make_docs(rows, extra=True)).collect()}
    r = got[100, "x"]
    assert r["languages"] == ["a", "x"] and abs(r["score"] - 0.75) < 0.03
    assert got[101, "a"]["languages"] == ["a"] and got[105, "a"]["score"] == 1.0
    assert {k for k in got if k[1] == "und"} == {(102, "und"), (103, "und"), (104, "und")}
    assert (None, "a") in got and (104, "x") in got


def test_empty_and_unlabelled(make_docs):
    assert op6.identify(make_docs([])).count() == 0
    rows = op6.identify(make_docs([(1, "words here"), (2, "more of them")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_keep_identified(make_docs):
    rows = [(i, "aba bab abba", "a") for i in range(8)] + [(50, None, "a"), (51, "123", "a")]
    kept = op6.keep_identified(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == set(range(8))


def test_em_reaches_the_likelihood_of_a_grid():
    rnd = np.random.default_rng(1)
    scores = np.log(rnd.dirichlet([1, 1], size=300)) * 3
    members, pi = op6.mixture(scores, rounds=200)
    like = [np.log(np.exp(scores) @ [p, 1 - p]).sum() for p in np.linspace(0.001, 0.999, 500)]
    value = np.log(np.exp(scores[:, members]) @ pi).sum()
    assert value > max(like) - 0.05 or len(members) == 1

"""Language identification by multilingual mixture inference (operator 6).

*Learning.*  Per language, the counts of the character trigrams of all
learning texts (a letter with its two neighbours, word ends included), hashed
to ``BUCKETS`` buckets; Spark sums them over the partitions, and the result
has a fixed size.  A word's likelihood in a language is the product of its
trigrams' smoothed shares.

*Prediction.*  A document's words come from a mixture of languages with
unknown proportions.  Expectation-maximisation estimates the proportions from
the words' likelihoods.  The set of languages is chosen by penalised
likelihood: of the sets made of the m languages with the largest proportions,
m = 1, 2, ..., the one with the largest log-likelihood less
``PENALTY / 2 * m * log(words)`` (so a second language needs more than a few
odd words).  ``lang_pred`` is the largest proportion's language, ``score`` its
proportion, ``languages`` the set.

Texts without a letter (or null) are ``und`` with score 0; so is everything
when nothing was learned.  Ties go to the alphabetically first language.
Repeated rows are predicted alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bucket_of, prepare

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS = 12
#: Texts are taken together in groups of about this many characters.
GROUP_CHARS = 1 << 20

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all trigrams, where each word begins among them, the text that each word belongs to)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), dtype="<u4")
    letter = letters()[codes]
    at = np.flatnonzero(letter)
    c = np.where(letter, codes, 32).astype(np.uint64) * _MUL[0]
    c ^= c >> np.uint64(31)
    h = c[at - 1] * _MUL[1] + c[at] * _MUL[2] + c[at + 1]
    buckets = ((h ^ (h >> np.uint64(32))) * _MUL[0] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    starts = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in low])
    return buckets, starts, np.searchsorted(ends, at[starts], side="right")


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, texts) of runs of texts with about GROUP_CHARS characters; null as empty."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS or i == len(texts) - 1:
            yield start, i + 1, [x or "" for x in texts[start:i + 1]]
            start, size = i + 1, 0


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in batches:
            of = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for k, lang in enumerate(langs):
                for _, _, group in _groups([t for t, x in zip(texts, of) if x == lang]):
                    total[k] += np.bincount(trigrams(group)[0], minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b], pa.int64())],
                                         names=["k", "b", "n"])
    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, counts [language, bucket]) over all rows with a text and a language."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("l is not null and t is not null")
    langs = sorted(r["l"] for r in rows.select("l").distinct().collect())  # one row per language
    total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
    if langs:
        f = rows.mapInArrow(_count(langs), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
        total[f["k"], f["b"]] = f["n"]  # at most languages x BUCKETS rows
    return langs, total


class Model:
    """Log-shares of the trigrams per language."""

    def __init__(self, langs: list[str], total: np.ndarray):
        self.langs = langs
        share = (total + SMOOTHING) / (total.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        self.table = np.ascontiguousarray(np.log(share).T.astype(np.float32))

    def word_scores(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the log-likelihoods [word, language] of its words."""
        buckets, starts, of = trigrams(texts)
        if not len(starts):
            return [np.zeros((0, len(self.langs)))] * len(texts)
        scores = np.add.reduceat(self.table[buckets], starts, axis=0).astype(np.float64)
        return np.split(scores, np.searchsorted(of, np.arange(1, len(texts))))


def mixture(scores: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """(set, proportions) of one document from its words' log-likelihoods [word, language]."""
    n, k = scores.shape
    cost = penalty / 2 * np.log(n + 1)
    top = scores.max(axis=1, keepdims=True)
    single = scores.sum(axis=0)
    if float(top.sum() - single.max()) <= cost:  # no mixture can gain more than that
        return [int(single.argmax())], np.ones(1)
    like = np.exp(np.maximum(scores - top, -60.0))

    def fit(members: list[int], start: np.ndarray) -> tuple[np.ndarray, float]:
        x, pi = like[:, members], start[members] + 1e-6
        pi = pi / pi.sum()
        for _ in range(rounds):
            g = x * pi
            total = g.sum(axis=1)
            new = (g / total[:, None]).mean(axis=0)
            done = np.abs(new - pi).max() < 1e-4
            pi = new
            if done:
                break
        return pi, float(np.log((x * pi).sum(axis=1)).sum() + top.sum())

    best, members, pi = float(single.max()) - cost, [int(single.argmax())], np.ones(1)
    if k > 1:
        every, whole = fit(list(range(k)), np.full(k, 1.0 / k))
        if whole - 2 * cost > best:  # no larger set can win otherwise
            order = sorted(range(k), key=lambda j: (-every[j], j))
            for m in range(2, k + 1):
                got, value = fit(sorted(order[:m]), every)
                if value - m * cost > best:
                    best, members, pi = value - m * cost, sorted(order[:m]), got
    return members, pi


def _predict(shared):
    state: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in state:
            state["m"] = Model(*shared.value)
        model = state["m"]
        for batch in batches:
            out = []
            for _, _, group in _groups(batch.column(1).to_pylist()):
                for scores in model.word_scores(group) if model.langs else [np.zeros((0, 0))] * len(group):
                    if not len(scores):
                        out.append(("und", 0.0, []))
                        continue
                    members, pi = mixture(scores)
                    at = int(pi.argmax())
                    out.append((model.langs[members[at]], float(min(1.0, pi[at])), [model.langs[j] for j in members]))
            lang, score, langs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))],
                names=["row", "lang_pred", "score", "languages"])
    return run


def held_out(key: Column) -> Column:
    return bucket_of(key, "", 4) == 2


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) of ``docs`` with lang_pred, score and languages beside them."""
    spark = docs.sparkSession
    prepare(spark)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS counts
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text_"))
    kept = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_predict(shared), f"row {kept}, lang_pred string, score double, languages array<string>")
    return out


def identify(docs: DataFrame) -> DataFrame:
    """The registered query: learn from the learning rows, predict every row."""
    learning = docs.filter(~held_out(F.col("doc_id")))
    model = learn(learning)
    out = predict(docs, model, ["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with a language that holds at least ``least`` of the words; the rest goes.

    The model is learned from the learning rows of ``docs`` itself.
    """
    out = predict(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")

"""Quality classifier by attention-based multiple-instance learning (operator 3).

A document is a bag of passages (``PASSAGE`` words each, over its whole text).
Every passage is encoded as a vector: shares of character classes, word shape,
repetition and hashed letter pairs.  The model embeds a passage, h = tanh(W x),
weighs the embeddings with gated attention,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and scores the weighted passage
representation: sigmoid(c . sum a h).  Only the documents' labels are learned
from; which passages speak for them is what the attention finds.

The model is fitted on the driver, on a bounded sample of labelled learning
rows (``SAMPLE`` documents at most, those with the least hash of the id), whose
passages are encoded by Spark.  Scoring runs over all passages of all
documents in the tasks; a text is encoded in parts of whole passages, so long
texts need no more memory than short ones.

Empty and null texts are one passage of zeros and get a score like any other.
Without learning rows of both labels, all scores are the learning rows' mean
label (0.5 without any).  Several labels for one id: the largest counts;
null labels don't.  Repeated rows are scored alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bucket_of, prepare

PASSAGE = 64
#: Labelled documents to fit on, at most.
SAMPLE = 3000
HIDDEN, ATTENTION = 24, 12
PAIRS = 32
GROUP_BYTES = 1 << 20
#: Characters that have a class of their own; the others share one of the classes that follow.
MARKS = b".,;:!?|*$%&#@/\\-_=<>()[]{}\"'+~^"

_CLASS = np.full(256, len(MARKS) + 5, dtype=np.int64)
_CLASS[ord("a"):ord("z") + 1] = len(MARKS)
_CLASS[ord("A"):ord("Z") + 1] = len(MARKS) + 1
_CLASS[ord("0"):ord("9") + 1] = len(MARKS) + 2
_CLASS[0x80:0xC0] = len(MARKS) + 3
_CLASS[0xC0:] = len(MARKS) + 4
for _i, _b in enumerate(MARKS):
    _CLASS[_b] = _i
CLASSES = len(MARKS) + 6
SHAPES = 8
WIDTH = CLASSES + SHAPES + PAIRS
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = _CLASS < len(MARKS)
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors [passage, WIDTH], the text of each passage) of UTF-8 texts; a text without words has one passage of zeros."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, starts, side="right")
    first = np.searchsorted(of, np.arange(len(texts)))
    cut = (np.arange(len(starts)) - first[of]) % PASSAGE == 0 if len(starts) else np.zeros(0, dtype=bool)
    passage = np.cumsum(cut) - 1
    n = int(cut.sum())
    owner = of[cut] if n else np.zeros(0, dtype=np.int64)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if n:
        size = stops - starts
        body = raw[~space]
        p = np.repeat(passage, size)
        begin = np.cumsum(size) - size
        total = np.bincount(p, minlength=n)
        words = np.bincount(passage, minlength=n)
        x[:, :CLASSES] = np.bincount(p * CLASSES + _CLASS[body], minlength=n * CLASSES).reshape(n, CLASSES) / total[:, None]
        place = np.minimum(np.arange(len(body)) - np.repeat(begin, size), 255)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(_BYTE[body] * _PLACE[place], begin)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        distinct = np.unique((passage.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))) >> np.uint64(36)
        last = body[begin + size - 1]
        upper = np.bincount(np.repeat(np.arange(len(size)), size), weights=_CLASS[body] == len(MARKS) + 1, minlength=len(size))
        shapes = [
            np.bincount(passage, weights=same, minlength=n) / words, np.bincount(distinct.astype(np.int64), minlength=n) / words,
            total / words / 10, np.sqrt(np.bincount(passage, weights=size.astype(float) ** 2, minlength=n) / words) / 10,
            np.bincount(passage, weights=_MARK[last], minlength=n) / words, np.bincount(passage, weights=_MARK[body[begin]], minlength=n) / words,
            np.bincount(passage, weights=upper * 2 >= size, minlength=n) / words, words / PASSAGE]
        x[:, CLASSES:CLASSES + SHAPES] = np.stack(shapes, axis=1)
        low = _LOWER[body]
        pair = (low[:-1] * 31 + low[1:] * 7 + (low[:-1] ^ low[1:])) % PAIRS
        inside = np.ones(len(body), dtype=bool)
        inside[begin] = False
        keep = inside[1:]
        counts = np.bincount(p[1:][keep] * PAIRS + pair[keep], minlength=n * PAIRS).reshape(n, PAIRS)
        x[:, CLASSES + SHAPES:] = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    missing = np.setdiff1d(np.arange(len(texts)), owner)
    if len(missing):
        x = np.concatenate([x, np.zeros((len(missing), WIDTH), dtype=np.float32)])
        owner = np.concatenate([owner, missing])
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
    return x, owner


def in_parts(text: bytes, size: int = GROUP_BYTES) -> list[bytes]:
    """A long text in parts of whole passages."""
    if len(text) <= size:
        return [text]
    words = text.split()
    step = PASSAGE * max(1, size // (PASSAGE * 8))
    return [b" ".join(words[i:i + step]) for i in range(0, max(1, len(words)), step)]


def grouped(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(parts, the text of each part) in groups of about GROUP_BYTES bytes; the parts of one text may span groups."""
    parts, of, size = [], [], 0
    for i, t in enumerate(texts):
        for part in in_parts(t or b""):
            parts.append(part)
            of.append(i)
            size += len(part)
            if size >= GROUP_BYTES:
                yield parts, np.array(of)
                parts, of, size = [], [], 0
    if parts:
        yield parts, np.array(of)


@dataclass
class Model:
    """Weights of the network; ``mean`` and ``scale`` standardise the passages.  ``prior`` replaces it where nothing was learned."""
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float | None = None

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention before softmax, c . h) of every passage."""
        w = self.weights
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w["W"] + w["b"])
        gate = np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))
        return gate @ w["w"], h @ w["c"]


def fit(x: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log-loss of the bags; ``bag`` is sorted and says whose a passage is."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    if len(label) == 0 or label.min() == label.max():
        return Model(mean, scale, {}, float(label.mean()) if len(label) else 0.5)
    z = np.clip((x - mean) / scale, -8, 8)
    rnd = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "c0": (1,)}
    par = {k: rnd.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    par["b"][:] = 0
    par["c0"][:] = 0
    m = {k: np.zeros_like(v) for k, v in par.items()}
    v = {k: np.zeros_like(p) for k, p in par.items()}
    begin = np.searchsorted(bag, np.arange(len(label) + 1))
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(rnd.permutation(len(label)), max(1, len(label) // 64)):
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in batch])
            size = begin[batch + 1] - begin[batch]
            at = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(batch)), size)
            xb, yb = z[rows], label[batch]
            h = np.tanh(xb @ par["W"] + par["b"])
            tv, su = np.tanh(h @ par["V"]), 1 / (1 + np.exp(-(h @ par["U"])))
            e = (tv * su) @ par["w"]
            a = np.exp(e - np.maximum.reduceat(e, at)[owner])
            a /= np.add.reduceat(a, at)[owner]
            bagged = np.add.reduceat(a[:, None] * h, at, axis=0)
            prob = 1 / (1 + np.exp(-(bagged @ par["c"] + par["c0"])))
            d = (prob - yb) / len(batch)
            g = {"c": bagged.T @ d, "c0": np.array([d.sum()])}
            db = d[:, None] * par["c"]
            da = (db[owner] * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, at)[owner])
            dh = a[:, None] * db[owner]
            g["w"] = (tv * su).T @ de
            dg = de[:, None] * par["w"]
            dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            g["V"], g["U"] = h.T @ dv, h.T @ du
            dh += dv @ par["V"].T + du @ par["U"].T
            dp = dh * (1 - h**2)
            g["W"], g["b"] = xb.T @ dp, dp.sum(axis=0)
            t += 1
            for k in par:
                grad = g[k] + decay * par[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                par[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, {k: p.astype(np.float64) for k, p in par.items()})


def held_out(key: Column) -> Column:
    return bucket_of(key, "", 3) == 1


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for parts, of in grouped(batch.column(2).to_pylist()):
            x, owner = encode(parts)
            got = [(ids[i], labels[i], x[of[owner] == i].tobytes()) for i in np.unique(of)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [pa.int64(), pa.int32(), pa.binary()])],
                                             names=["doc_id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that aren't held out."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")) \
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(F.col("doc_id").cast("long"), "label", "t")
    got = rows.mapInArrow(_encode_rows, "doc_id long, label int, x binary").orderBy("doc_id").collect()
    ids = sorted({r["doc_id"] for r in got})
    at = {k: i for i, k in enumerate(ids)}
    label = np.zeros(len(ids))
    xs, bag = [np.zeros((0, WIDTH), dtype=np.float32)], []
    for r in got:
        x = np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH)
        xs.append(x)
        bag += [at[r["doc_id"]]] * len(x)
        label[at[r["doc_id"]]] = r["label"]
    x = np.concatenate(xs)
    return fit(x if len(x) else np.zeros((1, WIDTH), dtype=np.float32), np.array(bag, dtype=np.int64), label)


def score_texts(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Scores of whole texts; the softmax over a text's passages is summed up part by part."""
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    top = np.full(len(texts), -np.inf)
    weight, value = np.zeros(len(texts)), np.zeros(len(texts))
    for parts, of in grouped(texts):
        x, owner = encode(parts)
        e, s = model.passages(x)
        doc = of[owner]
        higher = top.copy()
        np.maximum.at(higher, doc, e)
        shrink = np.zeros(len(texts))
        seen = np.isfinite(top)
        shrink[seen] = np.exp(top[seen] - higher[seen])
        a = np.exp(e - higher[doc])
        weight = weight * shrink + np.bincount(doc, weights=a, minlength=len(texts))
        value = value * shrink + np.bincount(doc, weights=a * s, minlength=len(texts))
        top = higher
    return 1 / (1 + np.exp(-(value / weight + model.weights["c0"][0])))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, texts), pa.float64())],
                                             names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The registered query: (doc_id, held_out, score, predicted) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    out = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

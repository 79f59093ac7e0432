"""Removal of long repeated passages with difference-cover anchors (operator 12).

A window is ``LENGTH`` consecutive words of one text; a word goes if a window over
it has a word sequence that also starts anywhere else.

*Anchors.*  ``COVER`` is a difference cover modulo ``PERIOD``: any two places have a
shift below the period that brings both onto cover places.  So two equal windows
share an anchor, a run of ``ANCHOR`` = LENGTH - PERIOD + 1 words that starts at
a cover place in both.  Only anchors are hashed, 5 of 21 places.

*Extension.*  A window without an anchor that occurs twice is not repeated.  The
others are hashed whole (128 bits), wherever the anchors say so.  A
window is repeated unless its hash occurs once.

*What is shuffled.*  Equal texts are one first (``texts``); their copies are
repeated as a whole.  Occurrences are counted by hash with partial sums, and what
occurs once comes back to its text from the aggregate itself, which holds its
place: no join on a hash, so a passage that a third of all texts share
is a few partial sums.  The texts lie in buckets of their key, so places come to
texts without moving the texts again.  64-bit hashes of anchors only choose
windows; collisions there cost time, not results.

Null texts have no words.  Rows with one ``doc_id``, or none, are texts of their
own; equal ones are copies of each other.  Texts are read in parts
(``PART`` bytes), so a very long one needs little more memory than itself.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import drop_shuffles, prepare, shared_path, stage, whole_text

LENGTH = 35
PERIOD = 21
#: Every difference modulo 21 is one of two of these (fixed values of a perfect difference set).
COVER = (0, 1, 4, 14, 16)
ANCHOR = LENGTH - PERIOD + 1
#: Bytes of text that are hashed at a time.
PART = 1 << 20

_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 1 << 12
_RANDOM = np.random.default_rng(120_120)


def _odd(n: int) -> np.ndarray:
    return _RANDOM.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)


#: Two independent families: factors of bytes, of places in a word, of places in a window.
_FAMILIES = [(_odd(256), _odd(_PLACES), _odd(LENGTH)) for _ in range(2)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut at white space."""
    a = 0
    while len(text) - a > PART:
        m = _BREAK.search(text, a + PART)
        if not m:
            break
        yield text[a:m.start()]
        a = m.end()
    yield text[a:] if a else text


def word_hashes(texts: list[bytes], family: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many words each text has."""
    by_byte, by_place, _ = _FAMILIES[family]
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([1, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    body, begin = raw[~space], np.cumsum(size) - size
    place = np.arange(len(body), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    weight = by_place[place & (_PLACES - 1)] + (place // _PLACES).astype(np.uint64)
    return _mix(np.add.reduceat(by_byte[body] * weight, begin)), counts


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, family: int) -> np.ndarray:
    """Hash of the ``size`` words from each place of ``at``."""
    by_word = _FAMILIES[family][2]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        h += words[at + k] * by_word[k]
    return _mix(h)


def blocks(texts: list[bytes], size: int, families: tuple[int, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(word hashes by family, text number, place in its text) of words, about PART bytes of text at a time.

    Short texts share a block; the parts of a long one follow each other,
    with the last ``size - 1`` words of the one before, so that every window of ``size`` words lies in one block, once.
    """
    group, first, held = [], 0, 0

    def short() -> tuple:
        made = [word_hashes(group, f) for f in families]
        counts = made[0][1]
        text = np.repeat(np.arange(first, first + len(group)), counts)
        return [h for h, _ in made], text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)

    for k, t in enumerate(texts):
        if len(t) <= PART:
            group.append(t)
            held += len(t)
        if group and (held >= PART or len(t) > PART or k == len(texts) - 1):
            yield short()
        if held >= PART or len(t) > PART:
            group, first, held = [], k + 1, 0
        if len(t) > PART:
            tail, n = [np.empty(0, dtype=np.uint64)] * len(families), 0
            for p in parts(t):
                own = [np.concatenate([old, word_hashes([p], f)[0]]) for old, f in zip(tail, families)]
                begin = n - len(tail[0])
                n = begin + len(own[0])
                yield own, np.full(len(own[0]), k), np.arange(begin, n)
                tail = [h[max(0, len(h) - size + 1):] for h in own]


def starts_of(text: np.ndarray, size: int) -> np.ndarray:
    """Places of a block from which ``size`` words of one text follow."""
    n = max(0, len(text) - size + 1)
    return np.flatnonzero(text[:n] == text[size - 1:])


def anchor_places(n_words: int) -> np.ndarray:
    n = max(0, n_words - ANCHOR + 1)
    places = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places < n]


def candidates(n_words: int, single: np.ndarray) -> np.ndarray:
    """Whether the window at each place has an anchor that isn't in ``single``, the places of anchors that occur once."""
    n = max(0, n_words - LENGTH + 1)
    repeated = np.zeros(n_words + 1, dtype=bool)
    repeated[anchor_places(n_words)] = True
    repeated[single] = False
    before = np.concatenate([[0], np.cumsum(repeated)])
    return before[PERIOD:PERIOD + n] > before[:n]


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Whether each word lies in one of the windows."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def texts_of(docs: DataFrame) -> DataFrame:
    """(k1, k2, copies, text): every different text once, in buckets of its 128-bit key.

    The buckets are an external table in the shared folder; its entry in the
    catalog goes at once, its files when the session ends.
    """
    spark = docs.sparkSession
    once = keyed(docs).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    name, path = f"texts_{uuid.uuid4().hex}", shared_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    drop_shuffles(spark)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(12), text).alias("k2"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = [0, 0]
    for batch in batches:
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")]
        for (words,), text, place in blocks(_texts(batch), ANCHOR, (0,)):
            at = starts_of(text, ANCHOR)
            at = at[np.isin(place[at] % PERIOD, COVER)]
            h = window_hashes(words, at, ANCHOR, 0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(x[text[at]]) for x in k], pa.array(place[at].astype(np.int32))],
                                             names=["h", "k1", "k2", "at"])


def _places(batch: pa.RecordBatch, col: str) -> list[np.ndarray]:
    """One array of places per row; null is none."""
    column = batch.column(col)
    return [np.empty(0, dtype=np.int64) if x is None else np.asarray(x.values, dtype=np.int64) if x.is_valid else np.empty(0, dtype=np.int64)
            for x in column]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")]
        texts, single = _texts(batch), _places(batch, "single")
        asked = [candidates(count_words(t), s) for t, s in zip(texts, single)]
        some = [n for n, c in enumerate(asked) if c.any()]
        first = np.cumsum([0, *[len(asked[n]) for n in some]])
        flat = np.concatenate([asked[n] for n in some]) if some else np.empty(0, dtype=bool)
        for words, text, place in blocks([texts[n] for n in some], LENGTH, (0, 1)):
            at = starts_of(text, LENGTH)
            at = at[flat[first[text[at]] + place[at]]]
            own = np.array(some)[text[at]] if some else at
            h = [window_hashes(w, at, LENGTH, f).view(np.int64) for f, w in enumerate(words)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, h), *[pa.array(x[own]) for x in k], pa.array(place[at].astype(np.int32))],
                                             names=["h", "g", "k1", "k2", "at"])


def count_words(text: bytes) -> int:
    return sum(len(word_starts(p)) for p in parts(text))


def word_starts(text: bytes) -> np.ndarray:
    space = _SPACE[np.frombuffer(b" " + text, dtype=np.uint8)]
    return np.flatnonzero(space[:-1] & ~space[1:])


def kept(text: bytes, copies: int, single: np.ndarray, lone: np.ndarray) -> tuple[int, int, str]:
    """(words, words removed, SHA-256 of the rest) of a text from the places of its anchors and windows that occur once."""
    n = count_words(text)
    windows = candidates(n, single)
    if copies > 1:
        windows[:] = True
    else:
        windows[lone] = False
    gone = covered(n, np.flatnonzero(windows))
    digest, at, begun = hashlib.sha256(), 0, False
    for part in parts(text):
        words = part.split()
        if gone[at:at + len(words)].any():
            rest = [w for w, g in zip(words, gone[at:at + len(words)].tolist()) if not g]
        else:
            rest = words
        if rest:
            digest.update((b" " if begun else b"") + b" ".join(rest))
            begun = True
        at += len(words)
    return n, int(gone.sum()), digest.hexdigest()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [kept(*x) for x in zip(_texts(batch), batch.column("copies").to_pylist(), _places(batch, "single"), _places(batch, "lone"))]
        n, gone, sha = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(sha, pa.string())], names=["k1", "k2", "n_words", "n_removed", "kept_sha256"])


def occur_once(hashes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(k1, k2, places) of the hashes that occur once: their groups have one row, whose key and place the aggregate holds."""
    groups = hashes.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "at")])
    return groups.filter("n = 1").groupBy("k1", "k2").agg(F.collect_list("at").alias(name))


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row; the registered query."""
    spark = docs.sparkSession
    prepare(spark)
    texts = texts_of(docs)
    anchors = texts.select("k1", "k2", "text").mapInArrow(_anchors, "h long, k1 long, k2 long, at int")
    single = stage(occur_once(anchors, ["h"], "single"), "single")
    drop_shuffles(spark)        # those of the job that has just ended go only now that nothing refers to it
    windows = texts.join(single, ["k1", "k2"], "left").select("k1", "k2", "text", "single") \
        .mapInArrow(_windows, "h long, g long, k1 long, k2 long, at int")
    lone = stage(occur_once(windows, ["h", "g"], "lone"), "lone")
    drop_shuffles(spark)
    marked = texts.join(single, ["k1", "k2"], "left").join(lone, ["k1", "k2"], "left")
    result = stage(marked.select("k1", "k2", "copies", "text", "single", "lone")
                   .mapInArrow(_kept, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string"), "kept")
    return keyed(docs).drop("text").join(result, ["k1", "k2"]).drop("k1", "k2")

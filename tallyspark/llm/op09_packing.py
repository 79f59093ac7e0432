"""Best-fit packing by minimum bin slack (operator 9).

A document's ids plus one end id form its piece; longer documents are cut so
that all pieces but the first have the full capacity.  Full pieces are
sequences of their own.  All that matters of the others is their length, and
there are fewer lengths than the capacity, whatever the number of documents.
So the packing is planned on the histogram of lengths (at most ``capacity``
numbers, counted by Spark over all pieces):

* per bin, a bitset subset-sum over the lengths still available finds the
  fullest feasible combination, and it is taken out;
* the same combination stays the fullest one while its lengths last, so it is
  taken out as often as they last in one step.  Each step uses up a length, so
  the plan has few steps and its size doesn't grow with the documents.

Pieces then find their place by their rank among the pieces of their length.
Ranks are dealt in slices of a hash of the document, so a length that a third
of all pieces share is numbered by many tasks.

Null texts are empty documents (the end id only).  Rows that share a document
id are packed each on its own.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import tokens
from tallyspark.llm.common import prepare, stage
from tallyspark.llm.op04_token_counts import byte_groups

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    cuts = ([0] if head else []) + list(range(head, n + 1, capacity))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _cut_documents(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(2)
            copies = batch.column(1).to_pylist()
            sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in byte_groups(sizes):
                rows = []
                for key, copy, text in zip(keys[a:b], copies[a:b], texts.slice(a, b - a).to_pylist()):
                    ids = np.array([*enc.ids(text or ""), end_id], dtype="<u4")
                    rows += [(key, copy, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                             for k, (s, n) in enumerate(piece_bounds(len(ids), capacity))]
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])
    return run


def cut_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) per piece; ``copy`` tells rows with one document id apart."""
    path = vocabulary or tokens.default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"),
                       F.col("text"))
    return rows.mapInArrow(_cut_documents(path, capacity, end_id), PIECES)


def fullest(available: dict[int, int], capacity: int, must: int) -> list[int]:
    """The fullest combination of available lengths that holds ``must`` and fits, as a list of lengths.

    Bit s of ``reach[k]`` says that the first k choices (a length with a power
    of two of copies each, the longest lengths first) can add up to s.
    """
    room = capacity - must
    mask, reach, items = (1 << (room + 1)) - 1, [1], []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, take = min(available[length] - (length == must), room // length), 1
        while left > 0:
            n = min(take, left)
            items.append((length, n))
            reach.append((reach[-1] | reach[-1] << (length * n)) & mask)
            left, take = left - n, take * 2
        if reach[-1] >> room & 1:
            break
    total, out = reach[-1].bit_length() - 1, [must]
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            length, n = items[k - 1]
            out += [length] * n
            total -= length * n
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many bins get each; uses every piece once.

    Each bin must hold the longest length still there, which keeps long
    pieces, the hardest to place, from being left for the end.
    """
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        combo = fullest(left, capacity, max(left))
        need = {x: combo.count(x) for x in set(combo)}
        times = min(left[x] // n for x, n in need.items())
        out.append((combo, times))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def slots(steps: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Per step and length: the ranks it takes (``rank0`` up), copies per bin, first bin and the offset of the first copy."""
    rows, rank, first = [], {}, 0
    for combo, times in steps:
        offset = 0
        for x in sorted(set(combo), reverse=True):
            n = combo.count(x)
            rows.append((x, rank.get(x, 0), n, first, offset))
            rank[x] = rank.get(x, 0) + n * times
            offset += n * x
        first += times
    return pd.DataFrame(rows, columns=["length", "rank0", "copies", "first", "offset0"]).astype("int64")


def _place(table: pd.DataFrame):
    t = table.sort_values(["length", "rank0"]).reset_index(drop=True)
    key = t["length"].to_numpy() * (1 << 48) + t["rank0"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.searchsorted(key, f["length"].to_numpy() * (1 << 48) + f["rank"].to_numpy(), side="right") - 1
            s = t.iloc[at]
            k = f["rank"].to_numpy() - s["rank0"].to_numpy()
            f["sequence_id"] = s["first"].to_numpy() + k // s["copies"].to_numpy()
            f["offset"] = s["offset0"].to_numpy() + (k % s["copies"].to_numpy()) * f["length"].to_numpy()
            yield f.drop(columns=["rank"])
    return run


def ranked_in_length(pieces: DataFrame, slices: int) -> DataFrame:
    """``rank`` from 0 among the pieces of a length, in any fixed order; each length is numbered in ``slices`` parts."""
    p = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(slices)))
    sizes = p.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "copy", "piece")
    numbered = p.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("k")) \
        .drop("slice", "base", "k")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Two passes over the pieces, which are staged (a few numbers each): the
    histogram of lengths comes to the driver (at most ``capacity`` rows), the
    plan goes to the tasks (bounded by the capacity as well).
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = stage(cut_documents(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = ranked_in_length(pieces, slices).mapInPandas(
        _place(slots(plan(counts, capacity))), f"{PIECES}, sequence_id long, offset long")
    return placed.drop("copy")

"""Token counts (operator 4).

Batch encoding in Arrow functions that return lengths only.  Each Arrow batch
is cut into groups of about the same number of bytes, so a batch with a few
very long texts costs no more memory than one of many short ones, and a long
text is itself encoded in parts cut at safe boundaries (see ``tokens``).

Nulls count as empty texts (no token); repeated rows each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import tokens
from tallyspark.llm.common import prepare

#: Texts are taken into Python in groups of about this many bytes.
GROUP_BYTES = 4 << 20


def byte_groups(sizes: list[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of rows whose sizes add up to ``most`` at most, or hold one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def token_lengths(path: str, id_type: pa.DataType):
    """An Arrow function (key, text) -> (key, n_bytes, n_tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            col = batch.column(1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(col).to_pylist()]
            counts: list[int] = []
            for a, b in byte_groups(sizes):
                counts += [len(enc.ids(t or "")) for t in col.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``vocabulary`` is a file that the ``tokenizers`` library reads and that
    every executor has; ``over_limit`` says n_tokens > ``limit``.
    """
    prepare(docs.sparkSession)
    path = vocabulary or tokens.default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(token_lengths(path, pa.int64()), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

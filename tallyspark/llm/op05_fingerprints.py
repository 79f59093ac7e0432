"""Document fingerprints: one-permutation MinHash with packed bits (operator 5).

A document's shingles are its runs of five words; a shorter document is one
shingle, one without words has none.  Every shingle is hashed once.  The top
bits of the hash choose one of ``BINS`` bins, and a bin keeps its least hash:
after one sort of the hashes, the first of each run with the same bin.  An
empty bin takes the value of a full one by optimal densification: it walks the
bins in a random order of its own, the same for all documents, to the first
full one (the full bin with the least hash of the pair of bins).  Of each
bin's hash the low ``BITS`` bits are stored, as hex digits.

Two fingerprints agree in a bin when the shingles do (likeness J) or when the
stored bits do by chance, so the share of equal bins is J + (1 - J) / 2**BITS,
and the likeness is corrected for that.

All of it is row by row with SQL functions; only the text of the next document
moves.  Null texts count as empty; two documents without words have likeness
1, one without and one with words 0.  Where rows share an id, the smallest
text stands for the id as a next document (and the smallest fingerprint in
``near_next``); rows without id have no next document and are edited by
cutting only.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, stage, whole_text

WORDS = 5
BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
BITS = 8


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """xxhash64 of every run of ``size`` words (of all of them where there are fewer; none without words)."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))) \
        .otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS_LOG2).cast("int")


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: the stored bits of each bin (array of ints, empty without words)."""
    w, h, first, bins = (f"{out}_{x}_" for x in ("words", "hashes", "first", "bins"))
    plain = F.translate(F.col(text_col), "\t\n\x0b\x0c\r", "     ")
    df = df.withColumn(w, F.array_remove(F.split(plain, " "), ""))
    df = df.withColumn(h, F.sort_array(shingle_hashes(F.col(w)))).drop(w)
    df = df.withColumn(first, F.filter(F.col(h), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(h), i - 1))))).drop(h)
    df = df.withColumn(bins, F.transform(first, _bin))

    def value(b: Column) -> Column:
        own = F.array_position(F.col(bins), b).cast("int")
        probe = F.array_min(F.transform(F.col(bins), lambda j, k: F.struct(F.hash(b * BINS + j).alias("order"), k.alias("at"))))
        at = F.when(own > 0, own - 1).otherwise(probe["at"])
        return F.get(F.col(first), at).bitwiseAND((1 << BITS) - 1).cast("int")

    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)
    return df.withColumn(out, F.when(F.size(bins) > 0, full).otherwise(F.array().cast("array<int>"))).drop(first, bins)


def packed(bits: Column) -> Column:
    """The stored bits as lowercase hex digits."""
    return F.lower(F.array_join(F.transform(bits, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << BITS)
    j = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) == 0) & (F.size(b) == 0)
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both, 1.0).when(either, 0.0).otherwise(F.greatest(F.lit(0.0), j))


#: Bits of an id that one level of ``successors`` looks at; together 64.
LEVELS = (12, 16, 18, 18)


def successors(ids: DataFrame, col: str = "id", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(id, next) for distinct ids, next null for the largest, without one global order.

    Ids that agree but for their lowest bits are ordered among themselves (at
    most 2**bits of them); the last of such a block is followed by the least id
    of the next block there is, which one more level finds among the blocks.
    """
    last_level = len(levels) == 1
    block = F.lit(0) if last_level else F.shiftright(F.col(col), levels[0])
    rows = ids.select(F.col(col).alias("id"), block.alias("block"))
    rows = rows.withColumn("next", F.lead("id").over(Window.partitionBy("block").orderBy("id")))
    if last_level:  # at most 2**bits ids are left, of both signs
        return rows.select("id", "next")
    heads = rows.groupBy("block").agg(F.min("id").alias("head"))
    after = successors(heads.select(F.col("block").alias("id")), "id", levels[1:]).filter("next is not null")
    first = after.join(heads.withColumnRenamed("block", "next"), "next").select(F.col("id").alias("block"), "head")
    last = rows.filter("next is null").join(first, "block", "left").select("id", F.col("head").alias("next"))
    return rows.filter("next is not null").select("id", "next").unionByName(last)


def next_documents(docs: DataFrame) -> DataFrame:
    """(id, next, take): the id that follows, the first after the last, and how many code points of it an edit takes."""
    own = docs.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.floor(F.char_length(whole_text()) / 4)).cast("int").alias("take"))
    own = stage(own, "ids")
    after = successors(own.select(F.col("doc_id").alias("id")))
    least = own.agg(F.min("doc_id").alias("least"))
    after = after.crossJoin(F.broadcast(least)).select("id", F.coalesce("next", "least").alias("next"))  # one row
    return stage(after.join(own.withColumnRenamed("doc_id", "id"), "id"), "next")


def edited_texts(docs: DataFrame, follows: DataFrame) -> DataFrame:
    """(doc_id, text, edited): the last quarter of the code points replaced by the first ones of the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # a left join, as the one below: an inner one would filter the rows, and the exchange of the texts couldn't be used for both
    heads = rows.join(follows.select(F.col("next").alias("doc_id"), F.col("id").alias("of"), "take"), "doc_id", "left") \
        .select("of", F.expr("left(text, take)").alias("head")).groupBy("of").agg(F.min("head").alias("head"))
    both = rows.join(heads.withColumnRenamed("of", "doc_id"), "doc_id", "left")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"),
                      F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut))
    return both.select("doc_id", "text", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The registered query: fingerprints of every text and its edited text, and their likenesses."""
    spark = docs.sparkSession
    prepare(spark)
    follows = next_documents(docs)
    rows = edited_texts(docs, follows)
    rows = with_fingerprint(with_fingerprint(rows, "text", "own"), "edited", "other")
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.col("own").cast("array<smallint>").alias("own"), F.col("other").cast("array<smallint>").alias("other"))
    rows = stage(rows, "bits")
    following = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("own").alias("next_bits")) \
        .join(follows.select(F.col("next").alias("doc_id"), "id"), "doc_id").select(F.col("id").alias("doc_id"), "next_bits")
    out = rows.join(following, "doc_id", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"),
                      packed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
                      F.coalesce(likeness(F.col("own"), F.col("next_bits")), F.lit(0.0)).alias("near_next"))

"""Trie of conversation prefixes by van Emde Boas recursion (operator 13).

Sequences are cut at half their depth, both halves again, and so on: cuts of
level j lie at odd multiples of 2^j.  All pieces of a level are worked on in one
round, so a trie of depth D takes about log D rounds, whatever its shape, and
every round halves the rows, so a conversation of a million turns is no task of its own.

*Names* (``names``).  Upwards, the halves of aligned pieces become the name of
the piece.  Downwards, the name of the prefix at a cut and that of the upper
half behind it give the name of the prefix at the cut between: the upper
trie and the lower forests below its leaves get their names in the same rounds.
Names are 128 bits of SHA-256, so equal prefixes have equal names in any conversation.

*Totals* (``grafted``).  Upwards, a node at a cut holds what lies below it inside its
piece; lower forests are grafted on the upper trie by adding their tops to
the node half a piece above.  Downwards, what lies below a node's piece is
added, from tops that are complete.  Each node is added to one node a level,
by partial sums.

Nodes are found by name; the least member of a node tells its ancestors'
names (``pointers``: the ones half a piece above, at most two a node on average).

``trie`` orders turns by turn (null first; ties by the SHA-256 of role and
text) and splices the first turns of another conversation in, as the query's
contract says.  Null roles and texts are empty.  Rows without a conversation id belong to no
conversation.  Repeated rows are turns of their own.  Texts of any length are hashed
and counted in place and never shuffled.  An empty table gives an empty result; other columns are ignored.

The digest of a node's ends is one sequential hash by contract: one task streams the
ids of a node, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, stage
from tallyspark.llm.ranks import ranked

WORDS = r"[^\x20\x09-\x0D]+"
ROOT = "0" * 32
#: Conversations of a splice group, and the turns that may be spliced in are fewer than this.
GROUP, SPLICE = 20, 4


def name_of(*parts: Column) -> Column:
    """128 bits of SHA-256 as hex."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, size, turn, words): place among the turns of a conversation, the name of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.char_length(F.regexp_replace(text, WORDS, "x")) - F.char_length(F.regexp_replace(text, WORDS, ""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("nth"),
        name_of(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("turn"), words.cast("long").alias("words"))
    return ranked(rows.filter("conv is not null"), "conv", ["nth", "turn"], "turns").drop("nth")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, depth, turn, words), depth from 1, and (conv, length) of all conversations, turnless ones too."""
    turns = stage(turns, "turns")
    own = turns.filter("pos = 0").select("conv", F.col("size").alias("n"))
    heads = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumn("h", F.crc32(F.col("conv").cast("string")) % SPLICE).withColumn("base", F.expr(f"conv - conv % {GROUP}")) \
        .join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = stage(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.filter(F.col("pos") < SPLICE - 1).select(F.col("conv").alias("base"), "pos", "turn", "words")
    taken = convs.select("conv", "base", "taken").join(first, "base").filter("pos < taken") \
        .select("conv", (F.col("pos") + 1).alias("depth"), "turn", "words")
    rest = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos >= h") \
        .select("conv", F.expr("taken + pos - h + 1").alias("depth"), "turn", "words")
    return stage(taken.unionByName(rest), "rebuilt"), convs.select("conv", "length")


def names(rows: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """(conv, length, depth, name): the name of every prefix of every conversation, the empty one included."""
    pieces = [rows.select("conv", (F.col("depth") - 1).alias("piece"), F.col("turn").alias("half"))]
    for _ in range(1, levels):
        odd = F.col("piece") % 2 == 1
        both = pieces[-1].groupBy("conv", F.expr("piece div 2").alias("piece")).agg(
            F.max(F.when(~odd, F.col("half"))).alias("upper"), F.max(F.when(odd, F.col("half"))).alias("lower"))
        pieces.append(stage(both.filter("upper is not null and lower is not null")
                            .select("conv", "piece", name_of(F.col("upper"), F.col("lower")).alias("half")), "pieces"))
    known = convs.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"))
    for j in range(levels - 1, -1, -1):
        upper = pieces[j].filter("piece % 2 = 0").select("conv", (F.col("piece") * (1 << j)).alias("depth"), "half")
        cuts = known.join(upper, ["conv", "depth"]).select(
            "conv", "length", (F.col("depth") + (1 << j)).alias("depth"), name_of(F.col("name"), F.col("half")).alias("name"))
        known = known.unionByName(stage(cuts, "cuts"))
    return known


def pointers(nodes: DataFrame, prefixes: DataFrame, levels: int) -> DataFrame:
    """(name, level, up): the names of a node's ancestors 2^level above, for the levels up to that of its own cut; 0 is its parent."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(max(0, levels - 1))), lambda j: F.expr("depth") % F.pow(F.lit(2), j) == 0)
    asked = nodes.filter("depth > 0").select("name", "conv_id", "depth", F.explode(steps).alias("level"))
    asked = asked.select("name", "level", F.col("conv_id").alias("conv"), (F.col("depth") - F.pow(F.lit(2), F.col("level"))).cast("long").alias("depth"))
    return asked.join(prefixes.select("conv", "depth", F.col("name").alias("up")), ["conv", "depth"]).select("name", "level", "up")


def grafted(nodes: DataFrame, up: DataFrame, values: list[str], levels: int) -> DataFrame:
    """(name, *values): the sums of ``values`` over the subtree of each of ``nodes`` (name, depth, *values)."""

    def add(to: DataFrame, tops: DataFrame, level: int) -> DataFrame:
        more = tops.join(up.filter(F.col("level") == level), "name").groupBy("up").agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        joined = to.join(more.withColumnRenamed("up", "name"), "name", "left")
        return joined.select("name", "depth", *[(F.col(v) + F.coalesce(F.col(f"{v}_more"), F.lit(0))).alias(v) for v in values])

    inside, cut = nodes.select("name", "depth", *values), []
    for j in range(levels):
        cut.append(inside.filter(F.col("depth") % (2 << j) == 1 << j))
        inside = stage(add(inside.filter(F.col("depth") % (2 << j) == 0), cut[j], j), "inside")
    whole = [inside]
    for j in range(levels - 1, -1, -1):
        tops = reduce(DataFrame.unionByName, whole).filter("depth > 0")
        whole.append(stage(add(cut[j], tops, j), "whole"))
    return reduce(DataFrame.unionByName, whole).drop("depth")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["name", "ends_sha256"]
    name, digest = None, None
    for batch in batches:
        done = []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key == name:
                digest.update(b",%d" % conv)
                continue
            if digest is not None:
                done.append((name, digest.hexdigest()))
            name, digest = key, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done) if done else ((), ()))], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=names)


def ends_of(prefixes: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the nodes at which conversations end."""
    ends = prefixes.filter("depth = length").select("name", "conv")
    return ends.repartition("name").sortWithinPartitions("name", "conv").mapInArrow(_digests, "name string, ends_sha256 string")


def build(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of all sequences: ``rows`` (conv, depth, turn, words) and ``convs`` (conv, length), both staged."""
    levels = int(convs.agg(F.max("length")).first()[0] or 0).bit_length()
    prefixes = names(rows, convs, levels)
    nodes = prefixes.groupBy("name", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    last = rows.select(F.col("conv").alias("conv_id"), "depth", "words")
    nodes = stage(nodes.join(last, ["conv_id", "depth"], "left"), "nodes")
    up = stage(pointers(nodes, prefixes, levels), "pointers")
    parents = up.filter("level = 0").select("name", "up")
    children = parents.groupBy(F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, "name", "left").select(
        "name", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0).cast("long"))).alias("saved_tokens")), "valued")
    totals = grafted(nodes, up, ["n_leaves", "saved_tokens"], levels)
    least = nodes.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    above = parents.join(least, "up").select("name", "parent_conv_id")
    none = hashlib.sha256().hexdigest()
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "name").join(above, "name", "left").join(ends_of(prefixes), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node; the registered query."""
    prepare(conversations.sparkSession)
    return build(*spliced(turns_of(conversations)))

"""Merkle manifest of a dataset with concatenated-level strings (operator 11).

Every row is a leaf: the SHA-256 of its fields, each as length, colon and
value.  Per language the leaves, by ascending ``doc_id``, form a tree of
fan-out 8; the roots of the languages form one more.

*Levels as strings.*  Rows are grouped in aligned blocks of 8^3 = 512
consecutive nodes.  A block keeps each of its levels as one string of hex
digests, 64 bytes a node.  Parents are hashes of substrings of 8 x 64 bytes,
again joined to a string; the siblings of a node are the two substrings that
flank it inside its run.  A block ends in one node, the blocks of a tree are the
nodes of the next round, and so on: 512 times fewer nodes a round.

*Proofs.*  Going back down, every round joins its blocks with the segments that
lie above them, so a row gets its flanking segments of all levels.  The proof
is their hash; the folded root is computed from them and the leaf that
is to be verified.

Only digests are shuffled, never texts, and no task sees more than a block or
a slice of a language (``ranks.ranked``).

Null fields are ``-``, so a null and an empty text differ.  Rows with one
``doc_id`` are leaves of their own, ordered by their digests; a null
``doc_id`` comes first and is never tampered with.  Texts of any length are
hashed in place.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stage
from tallyspark.llm.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest, children of a node (8 = 1 << SHIFT), levels of a block and nodes of a block.
WIDTH, SHIFT, LEVELS = 64, 3, 3
FAN, BLOCK = 1 << SHIFT, 1 << SHIFT * LEVELS
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, changed) per row; ``changed`` is the leaf of the tampered row, null where there is none.

    ``tree`` stands for the language: null is the empty string, others get a
    mark before them, so that it sorts as the languages do.
    """
    cols = [F.col(c) for c in FIELDS]
    tampered = leaf([*cols[:-1], F.translate(F.col("text"), ascii_uppercase, ascii_lowercase)])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf(cols).alias("digest"), F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).alias("changed"))


def _level(n: int) -> str:
    return f"level{n}"


def parents(level: str) -> Column:
    """The level above: hashes of the fixed-width substrings of one, joined."""
    run = WIDTH * FAN
    starts = F.sequence(F.lit(0), F.expr(f"cast((length({level}) - 1) div {run} as int)"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(F.col(level), i * run + 1, F.lit(run)), 256)), "").cast("binary")


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Aligned blocks of nodes (tree, pos, size, digest, *payload): their rows, their levels as strings and the node on top.

    ``size`` is the number of nodes of the tree, which tells at which level it has one left.
    """
    row = F.struct(F.col("pos").cast("long").alias("pos"), "digest", *payload)
    b = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(row)).alias("rows"))
    b = b.withColumn(_level(0), F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary"))
    for n in range(LEVELS):
        b = b.withColumn(_level(n + 1), F.when(F.col("size") > FAN ** n, parents(_level(n))))
    return b.withColumn("top", F.coalesce(*[_level(n) for n in range(LEVELS, -1, -1)]).cast("string"))


def climb(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Staged blocks of every round and (tree, digest) of the roots."""
    rounds: list[DataFrame] = []
    while True:
        b = stage(blocks(nodes, payload), "blocks")
        rounds.append(b)
        most = b.agg(F.max("size")).first()[0] or 0
        nodes = b.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.col("top").alias("digest"))
        payload = []
        if most <= BLOCK:
            return rounds, nodes.select("tree", "digest")


def segments(pos: Column) -> Column:
    """The flanking substrings of a node in its block, level by level, as far as its tree has more than one node."""
    place = (pos % BLOCK).cast("int")
    steps = []
    for n in range(LEVELS):
        at = F.shiftright(place, SHIFT * n)
        inside, level = at.bitwiseAND(FAN - 1), F.col(_level(n))
        left = F.substring(level, (at - inside) * WIDTH + 1, inside * WIDTH)
        right = F.substring(level, (at + 1) * WIDTH + 1, (FAN - 1 - inside) * WIDTH)
        steps.append(F.when(F.col("size") > FAN ** n, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def descend(rounds: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """Rows of the first round with ``path``, the segments of all levels from the row up.

    ``above`` is (tree, path, *carry): what lies above the root of each tree.
    """
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for b in reversed(rounds):
        upper = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), *carry)
        joined = b.join(upper, ["tree", "block"])
        rows = F.transform("rows", lambda r: F.struct(r.alias("row"), segments(r["pos"]).alias("own")))
        above = joined.select("tree", "upper", *carry, F.explode(rows).alias("x")).select(
            "tree", "x.row.*", F.concat("x.own", "upper").alias("path"), *carry)
    return above


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and the segments above it."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h.cast("binary"), s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row; the registered query."""
    nodes = ranked(leaves(docs), "tree", ["doc_id", "digest"], "leaves")
    rounds, subroots = climb(nodes, ["doc_id", "changed"])
    languages = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    upper, root = climb(ranked(languages, "tree", ["language"], "languages"), ["language"])
    top = root.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    trees = descend(upper, top, ["root"]).select(F.col("language").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = descend(rounds, stage(trees, "trees"), ["subroot", "root"])
    proof = F.aggregate("path", F.lit("").cast("binary"), lambda h, s: F.concat(h, s["left"], s["right"]))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
                       fold(F.col("path"), F.coalesce("changed", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

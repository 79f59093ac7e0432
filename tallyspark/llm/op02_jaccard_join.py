"""Exact n-gram Jaccard join by pivots, Voronoi regions and triangle windows (operator 2).

Documents are sets of distinct shingles of ``shingle`` words under the Jaccard
distance d = 1 - |x & y| / |x | y|, a metric; two link when d is at most
EPS = 1 - ``share`` / 100.  The query's contract has three words and 90; callers
of ``keep_one`` and ``join_components`` can give others.
Texts that are equal are one point of that space.

*First level.*  Documents as pivots tell nothing apart here: unrelated texts
are all at distance 1 from all of them, so every boundary window would hold
everything.  The first pivots are therefore sets of one shingle.  A document is
at distance 1 - 1/|x| from the pivots it holds and at 1 from the others, so its
nearest pivots are its own shingles; ties go to the rarest, by an order that
all documents share.  A document within EPS of x lacks at most
|x| - ceil((1 - EPS) |x|) of x's shingles, so its first shared pivot is among that
many plus one of x's: x is replicated to these regions.  Two documents that
link then meet in the region of their first shared pivot, where their sizes and
places must leave room for the overlap (``may_link``).

*Inside regions.*  Every region takes one of its documents as pivot, and the
distances to it are computed.  What links to it is one component already and
needs no pairs.  Regions whose documents still belong to several components and
that hold more than ``SMALL`` documents are split again, with documents as
pivots: each document goes to its nearest pivot's region and is replicated to
those at most 2 EPS further, which the triangle inequality shows to be enough;
and so on, ``LEVELS`` times at most and as long as a split separates anything.  The pairs of different components that
are left in a region, less those whose distances to a common pivot differ by
more than EPS, are compared one by one.  So a group of thousands of near copies
costs pairs in proportion to its size, and no link between components is lost.

The common order is by frequency, from a sketch of fixed size (``CELLS``
counters over the shingles of all documents), then by hash.  The order decides
the cost only, never the result.

Shingles are compared by 64-bit hashes of 64-bit word hashes.  Documents
without words (or null) have an empty set and link with nothing; rows that
share an id are points of their own; rows without an id take part, and their
component is the least id there is.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, release, stage, whole_text
from tallyspark.llm.components import connected_components

#: Values of the query's contract: words a shingle, and the share below.
SHINGLE = 3
WORD = r"[^\x20\x09-\x0D]"
#: Two sets link when 100 * intersection >= SHARE * union.
SHARE = 90
CELLS = 1 << 16
SMALL = 10_000
#: A split that more than this many times the rows come out of separates nothing; the regions' pairs are compared instead.
SPREAD = 2
LEVELS = 3
PIVOTS = 4
GROUP_BYTES = 1 << 20

#: A factor for each word of a shingle, so a shingle has at most as many words.
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 1 << 14
_RANDOM = np.random.default_rng(987654321)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, _PLACES, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of UTF-8 texts; A-Z lower-cased, words split at ASCII white space."""
    raw = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    if not len(starts):
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    body, begin = raw[~space], np.cumsum(size) - size
    place = np.arange(len(body)) - np.repeat(begin, size)
    weight = _PLACE[place & (_PLACES - 1)] + (place // _PLACES).astype(np.uint64) * _K[0]
    h = _mix(np.add.reduceat(_BYTE[body] * weight, begin))
    n_runs = max(0, len(h) - shingle + 1)
    runs = _mix(sum(h[k:k + n_runs] * _K[k] for k in range(shingle)))
    cuts = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= shingle:
            out.append(_distinct(runs[a:b - shingle + 1]))
        elif b > a:
            out.append(_mix((h[a:b] * _K[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def _grouped(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """The sets of texts one by one, made in groups of about GROUP_BYTES bytes; null as empty."""
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(t or b"")
        size += len(group[-1])
        if size >= GROUP_BYTES or k == len(texts) - 1:
            yield from shingle_sets(group, shingle)
            group, size = [], 0


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _loads(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for own in _grouped(batch.column(0).to_pylist(), shingle):
                np.add.at(total, _cell(own), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])
    return run


def shingle_loads(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Documents per cell of the sketch, over all documents; CELLS numbers whatever the input."""
    rows = texts.mapInArrow(_loads(shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, dtype=np.int64)
    for r in rows.collect():  # at most CELLS rows
        out[r["cell"]] = r["n"]
    return out


def prefix_length(n: int, share: int = SHARE) -> int:
    """Among so many of its first shingles, a set of n has one of any set it links with."""
    return n - -(-n * share // 100) + 1


def _signatures(loads: np.ndarray, shingle: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], []
            for s in _grouped(batch.column(2).to_pylist(), shingle):
                order = np.argsort(loads[_cell(s)], kind="stable")
                sizes.append(len(s))
                prefixes.append(s[order[:prefix_length(len(s), share)]].view(np.int64) if len(s) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists],
                                             names=["doc_id", "key", "n", "prefix"])
    return run


def _size_fits(n1: Column, n2: Column, share: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * share


def may_link(n1: Column, i1: Column, n2: Column, i2: Column, share: int = SHARE) -> Column:
    """Whether sets of these sizes, whose first shared shingle is at these places, can still share enough."""
    need = F.ceil((n1 + n2) * share / (100.0 + share) - 1e-9)
    return _size_fits(n1, n2, share) & (F.least(n1 - i1, n2 - i2) >= need)


def _compare(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for batch in batches:
            inter, union = [], []
            names, ta, tb = (batch.column(i).to_pylist() for i in (0, 2, 3))
            new = [a != b for a, b in zip(names, [last, *names])]  # rows come sorted by a
            sets = _grouped([t for k, x in enumerate(tb) for t in ((ta[k], x) if new[k] else (x,))], shingle)
            for k, a in enumerate(names):
                if new[k]:
                    last, own = a, next(sets)
                other = next(sets)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                inter.append(both)
                union.append(len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                                             names=["a", "b", "inter", "union"])
    return run


def distances(pairs: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """(a, b, d, linked) for pairs of points, from their whole texts."""
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    rows = pairs.select("a", "b").distinct().join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    rows = rows.mapInArrow(_compare(shingle), "a long, b long, inter long, union long")
    return stage(rows.select("a", "b", (1 - F.col("inter") / F.col("union")).alias("d"),
                             (F.col("inter") * 100 >= F.col("union") * share).alias("linked")), "distances")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open_regions(members: DataFrame) -> DataFrame:
    """(region, size) of the regions whose documents belong to several components."""
    return members.groupBy("region").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")) \
        .filter("r0 < r1").select("region", "size")


def split(members: DataFrame, texts: DataFrame, level: int, shingle: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Split regions at ``PIVOTS`` of their documents: (members of the new regions, distances to the pivots).

    A document goes to its nearest pivot's region and to those at most 2 EPS further away.
    """
    chosen = [F.min(F.struct(F.xxhash64("node", F.lit(1000 * level + k)), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = members.groupBy("region").agg(*chosen) \
        .select("region", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.node") for k in range(PIVOTS)]))).alias("pivot"))
    pairs = stage(members.join(pivots, "region").select("region", "node", "n", "i", "pivot"), "pivots")
    d = distances(pairs.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), texts, shingle, share)
    at = pairs.join(d.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "d"), ["pivot", "node"], "left") \
        .withColumn("d", F.coalesce("d", F.lit(0.0)))
    home = at.groupBy("region", "node").agg(F.min("d").alias("home"))
    new = at.join(home, ["region", "node"]).filter(F.col("d") <= F.col("home") + 2 * (1 - share / 100) + 1e-9) \
        .select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "i", F.col("pivot"), F.col("d"))
    return stage(new, "regions"), d


def _pairs_left(members: DataFrame, share: int) -> DataFrame:
    """Pairs of a region that may link, belong to different components and lie in each other's window around the pivot."""
    x = members.select("region", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "i", "root", "d")])
    y = members.select("region", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "i", "root", "d")])
    near = F.coalesce(F.abs(F.col("d1") - F.col("d2")) <= 1 - share / 100 + 1e-9, F.lit(True))
    return x.join(y, "region").filter((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & near
                                      & may_link(F.col("n1"), F.col("i1"), F.col("n2"), F.col("i2"), share)) \
        .select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def text_key() -> Column:
    return F.unhex(F.md5(whole_text()))


def classes_of(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) per row of ``docs``, and (key, least, component_id, chosen) per distinct text with words.

    ``least`` is the least id with that text; ``chosen`` marks one text of each
    component: that of the least id (ties: the least key).
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), whole_text().cast("binary").alias("text"))
    loads = shingle_loads(rows.select("text"), shingle)
    sig = stage(rows.mapInArrow(_signatures(loads, shingle, share), "doc_id long, key binary, n long, prefix array<long>"), "signatures")
    points = sig.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    points = stage(points.withColumn("node", F.monotonically_increasing_id()), "points")
    slim = stage(sig.select("doc_id", "key", "n"), "rows")  # the prefixes go as soon as they have been used
    release(sig)

    pre = points.select("node", "n", F.posexplode("prefix").alias("i", "region"))
    shared = pre.groupBy("region").agg(F.count("*").alias("size"), F.min(F.struct("i", "n", "node")).alias("p")).filter("size > 1")
    members = stage(pre.join(shared.select("region", "p"), "region").select("region", "node", "n", "i", "p"), "members")
    names = stage(points.select("node", "key", "least"), "names")
    release(points)

    near = members.filter((F.col("node") != F.col("p.node")) & may_link(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i"), share))
    near = stage(near.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct(), "near")
    wanted = members.select("node").distinct().join(names.select("node", "key"), "node")
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")  # the aggregate's exchange serves the join
    texts = stage(texts.select("node", "text"), "texts")
    d = distances(near, texts, shingle, share)
    links = d.filter("linked").select("a", "b")
    roots = connected_components(links)

    to_pivot = d.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "d")
    left = members.select("region", "node", "n", "i", F.col("p.node").alias("pivot")).join(to_pivot, ["pivot", "node"], "left") \
        .withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("d"))).drop("pivot")
    found = []
    for level in range(LEVELS + 1):
        left = _with_roots(left, roots)
        left = stage(left.join(_open_regions(left), "region"), "open")
        ready = left if level == LEVELS else left.filter(F.col("size") <= SMALL)
        found.append(stage(_pairs_left(ready, share), "pairs"))
        large = left.filter(F.col("size") > SMALL)
        if level == LEVELS or large.isEmpty():
            break
        left, more = split(large.select("region", "node", "n", "i"), texts, level, shingle, share)
        links = links.unionByName(more.filter("linked").select("a", "b"))
        roots = connected_components(links)
        if left.count() > SPREAD * large.count():
            found.append(stage(_pairs_left(_with_roots(large.drop("root"), roots), share), "pairs"))
            break
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = pairs.join(d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    if not pairs.isEmpty():
        links = links.unionByName(distances(pairs, texts, shingle, share).filter("linked").select("a", "b"))
        roots = connected_components(links)

    named = _with_roots(names, roots)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), first.alias("first"))
    classes = named.join(least, "root").select("key", "least", "component_id", (F.col("key") == F.col("first.key")).alias("chosen"))
    classes = stage(classes, "classes")
    release(texts, members, near, names)
    return slim, classes


def join_components(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    sig, classes = classes_of(docs, shingle, share)
    out = sig.join(classes.select("key", "component_id"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row of each component, that of the least id; rows without words are nobody's copies and all stay."""
    _, classes = classes_of(docs, shingle, share)
    chosen = classes.filter("chosen").select(F.col("least").alias("least_"), F.col("key").alias("chosen_"))
    rows = docs.withColumn("key_", text_key())
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("least_")) & (F.col("key_") == F.col("chosen_")), "left_semi") \
        .filter(whole_text().rlike(WORD)).dropDuplicates(["doc_id", "key_"])
    return kept.select(*docs.columns).unionByName(docs.filter(~whole_text().rlike(WORD)))

"""Exact order statistics at scale: quantiles and average percentile ranks.

Spark's ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a global ``Window.orderBy`` runs in one task; neither
survives 100 TB.  This module computes the same exact numbers with plans
that never funnel a column through one task.

*Quantiles.*  A sample of rows gives two values around each wanted position; one pass
over all rows counts those below and at both.  A position that falls on one of the two
is known; only the rows strictly between them (about a sixtieth of a column) are
ranked.  The counts are exact, so a sample that missed shows, and that column is ranked
whole: results never depend on the sample.

*Percentile ranks* are ``(before + (c + 1) / 2) / n`` -- pandas' ``rank(pct=True)`` with
ties averaged.  The sample cuts each column at ``cuts`` values.  Rows that hold such a
value (every value with more than about ``1 / cuts`` of the rows is one) need only
counts, which fit a small table; the others are ranked inside their slice.
So a value with a third of all rows meets no shuffle, and no slice holds much more than ``1 / cuts``.

*Rank tables* (``rank_table``) give for every distinct value the rows strictly below it:
duplicates are counted map-side, distinct values are dealt by range, and a window
inside each slice starts at the offset of the slice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage, shuffle_partitions

#: Rows whose values tell where to look, and how far from a wanted place (as a share of the rows) the bounds lie: four deviations.
SAMPLE, SPARE = 65_536, 0.008
#: Values at which ``pct_ranks`` cuts a column, and rows that a range of the few rows between two bounds holds.
CUTS, SLICE = 256, 200_000


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row frame of global scalars (means, quantiles) to every row.

    The right side is a global aggregate -- exactly one row by construction --
    so this is a broadcast of a few numbers, not a product of two tables.
    """
    return df.crossJoin(F.broadcast(one_row))


def unpivot(df: DataFrame, id_cols: list[str], metrics: dict[str, Column | str]) -> DataFrame:
    """Long form ``(*id_cols, metric, value)``; ``metrics`` maps name -> expression."""
    structs = [
        F.struct(F.lit(name).alias("metric"), (F.col(e) if isinstance(e, str) else e).cast("double").alias("value"))
        for name, e in metrics.items()
    ]
    return (df.select(*id_cols, F.explode(F.array(*structs)).alias("_kv"))
              .select(*id_cols, "_kv.metric", "_kv.value"))


def rank_table(long_df: DataFrame, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """``(metric, value, c, before, n)`` for every distinct non-null value.

    ``c`` = rows with this value, ``before`` = rows of the metric strictly
    below it, ``n`` = non-null rows of the metric.  With ``weight``, a row counts
    as many times as that column says (0: the value is ranked but not counted).
    """
    p = partitions or shuffle_partitions(long_df.sparkSession)
    dv = (long_df.where(F.col("value").isNotNull() & ~F.isnan("value"))
                 .groupBy("metric", "value").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c")))
    # Range bounds come from a sample; materialise the sliced table once so the
    # offsets and the in-slice running counts see the very same slices.
    rp = cut_lineage(dv.repartitionByRange(p, "metric", "value").withColumn("_pid", F.spark_partition_id()))
    slice_tot = rp.groupBy("metric", "_pid").agg(F.sum("c").alias("_pc"))
    upto = Window.partitionBy("metric").orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = slice_tot.select(
        "metric", "_pid",
        (F.sum("_pc").over(upto) - F.col("_pc")).alias("_off"),
        F.sum("_pc").over(Window.partitionBy("metric")).alias("n"),
    )
    inside = Window.partitionBy("metric", "_pid").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = rp.withColumn("_run", F.sum("c").over(inside))
    # offsets has at most (partitions + metrics) rows: a proven bound.
    return (local.join(F.broadcast(offsets), ["metric", "_pid"])
                 .select("metric", "value", "c",
                         (F.col("_off") + F.col("_run") - F.col("c")).alias("before"), "n"))


def places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``, from 0 by ``order`` inside each ``group``; ``order`` ends in a unique column.

    Rows are dealt in slices by range; each slice starts at the number of rows before it, so no
    task numbers a whole group.
    """
    rp = cut_lineage(df.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = rp.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(group, "_pid").orderBy(*order)
    # starts has at most (partitions + groups) rows
    return (rp.join(starts, [group, "_pid"]).withColumn("place", F.col("_off") + F.row_number().over(inside) - 1)
              .drop("_pid", "_off"))


def quantiles_from_ranks(rt: DataFrame, probs: dict[str, list[float]]) -> DataFrame:
    """Exact linear-interpolated quantiles ``(metric, p, q)`` from a rank table.

    Matches ``quantile_cont`` / pandas ``quantile`` (``lo + (hi - lo) * frac``
    at position ``(n - 1) p``).  A metric without non-null values yields NULL.
    """
    spark = rt.sparkSession
    rows = [(m, float(p)) for m, ps in probs.items() for p in ps]
    req = spark.createDataFrame(rows, "metric string, p double")
    counts = rt.groupBy("metric").agg(F.max("n").alias("n"))
    pos = (F.broadcast(req).join(counts, "metric", "left")
           .withColumn("h", (F.col("n") - 1) * F.col("p"))
           .withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h"))
           .withColumn("frac", F.col("h") - F.col("lo")))
    ks = pos.select("metric", "p", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("lo").alias("k")),
        F.struct(F.lit("hi").alias("side"), F.col("hi").alias("k")))).alias("s")).select(
        "metric", "p", "s.side", "s.k")
    # ks is (#metrics x #probs x 2) rows: broadcast, range condition per metric.
    hit = rt.join(F.broadcast(ks), (rt.metric == ks.metric) & (rt.before <= ks.k) & (ks.k < rt.before + rt.c)) \
            .select(ks.metric, ks.p, ks.side, rt.value)
    vals = hit.groupBy("metric", "p").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("v_hi"))
    out = pos.join(vals, ["metric", "p"], "left")
    q = F.when(F.col("lo") == F.col("hi"), F.col("v_lo")).otherwise(
        F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
    return out.select("metric", "p", q.alias("q"))


def _few(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of a few rows that needs no job to read."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())}))


def _numbers(df: DataFrame, exprs: dict[str, Column | str], keep: list[str] = []) -> tuple[DataFrame, dict[str, str]]:
    """``df`` staged with its expressions as doubles m0, m1, ... without NaN, and the name of each metric's column."""
    names = {m: f"m{i}" for i, m in enumerate(exprs)}
    plain = all(isinstance(e, str) for e in exprs.values())
    value = {m: (F.col(e) if isinstance(e, str) else e).cast("double") for m, e in exprs.items()}
    wide = df.select(*keep, *[F.nanvl(value[m], F.lit(None).cast("double")).alias(names[m]) for m in exprs])
    return wide if plain and getattr(df, "_staged", False) else cut_lineage(wide), names


def quantiles(df: DataFrame, probs: dict[str, list[float]], exprs: dict[str, Column | str] | None = None,
              partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns at once -> ``(metric, p, q)``."""
    exprs = exprs or {m: m for m in probs}
    wide, names = _numbers(df, {m: exprs[m] for m in probs})
    found = _exact_quantiles(wide, {names[m]: ps for m, ps in probs.items()}, partitions)
    rows = [(m, float(p), found[names[m], float(p)]) for m, ps in probs.items() for p in ps]
    return _few(df.sparkSession, rows, metric=pa.string(), p=pa.float64(), q=pa.float64())


def _sampled(wide: DataFrame, cols: list[str]) -> dict[str, np.ndarray]:
    """The values of about SAMPLE rows, sorted; only bounds and cuts come from them, every row is counted."""
    few = wide.select(*cols)
    n = few.count()
    found = few.where(F.rand(42) < SAMPLE / n).toPandas() if n > SAMPLE else few.toPandas()
    values = {c: found[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in cols}
    return {c: np.sort(v[~np.isnan(v)]) + 0.0 for c, v in values.items()}


def _exact_quantiles(wide: DataFrame, probs: dict[str, list[float]], partitions: int | None,
                     nearest: bool = False) -> dict[tuple[str, float], float | None]:
    """(column, p) -> quantile: bounds by a sample, exact counts at them, and the ranks of the rows between.

    ``nearest``: the value at the place nearest to (n - 1) p instead of one between two."""
    asked = [(m, float(p)) for m, ps in probs.items() for p in ps]
    cols = list(probs)
    seen = _sampled(wide, cols)
    around = lambda m, p: np.quantile(seen[m] if len(seen[m]) else [0.0], [max(0.0, p - SPARE), min(1.0, p + SPARE)], method="nearest").tolist()
    bounds = {(m, p): tuple(around(m, p)) for m, p in asked}
    out: dict[tuple[str, float], float | None] = {key: None for key in asked}
    marks = [(cols.index(m), a, b) for (m, _), (a, b) in bounds.items()]

    def count(batches):
        """Per quantile the rows with a value, below the lower bound, at it, below the upper bound, at it."""
        total = np.zeros((len(marks), 5), dtype=np.int64)
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols]
            for i, (j, a, b) in enumerate(marks):
                v = values[j]
                total[i] += [(~np.isnan(v)).sum(), (v < a).sum(), (v == a).sum(), (v < b).sum(), (v == b).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(marks), dtype=np.int32)), *(pa.array(x) for x in total.T.copy())],
                                         names=["i", "n", "below", "at", "upto", "end"])

    sums = wide.select(*cols).mapInArrow(count, "i int, n long, below long, at long, upto long, end long").groupBy("i").agg(
        *[F.sum(c).alias(c) for c in ("n", "below", "at", "upto", "end")]).collect()                # a row per quantile
    sums = {r["i"]: r for r in sums}
    places, known, inside, missed = {}, {}, {}, []
    for i, ((m, p), (a, b)) in enumerate(bounds.items()):
        c = sums.get(i)
        if c is None or not c["n"]:
            continue
        h = round((c["n"] - 1) * p) if nearest else (c["n"] - 1) * p
        places[m, p] = (math.floor(h), math.ceil(h), h - math.floor(h))
        below, first, upto = c["below"], c["below"] + c["at"], c["upto"]
        for k in places[m, p][:2]:
            if below <= k < first:
                known[m, p, k] = a
            elif upto <= k < upto + c["end"]:
                known[m, p, k] = b
            elif first <= k < upto:
                inside.setdefault((m, p), {})[k - first] = k
            else:
                missed.append((m, p))
    number = {key: i for i, key in enumerate(bounds)}
    if inside:
        asked_for = [(i, cols.index(m), *bounds[m, p]) for (m, p), i in number.items() if (m, p) in inside]

        def between(batches):
            for batch in batches:
                for i, j, a, b in asked_for:
                    v = batch.column(cols[j]).to_numpy(zero_copy_only=False).astype(np.float64)
                    v = v[(v > a) & (v < b)]
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, dtype=np.int32)), pa.array(v + 0.0)], names=["metric", "value"])

        few = wide.select(*cols).mapInArrow(between, "metric int, value double")
        total = sum(sums[i]["upto"] - sums[i]["below"] - sums[i]["at"] for i, *_ in asked_for)
        parts = partitions or min(shuffle_partitions(wide.sparkSession), 1 + total // SLICE)
        ranks = rank_table(few, parts)
        wanted = _few(wide.sparkSession, [(number[key], k) for key, ks in inside.items() for k in ks], metric=pa.int32(), k=pa.int64())
        hits = ranks.join(F.broadcast(wanted), "metric").where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c")))
        keys = list(bounds)
        for r in hits.select("metric", "k", "value").collect():            # two places a quantile
            key = keys[r["metric"]]
            known[(*key, inside[key][r["k"]])] = r["value"]
    for key, (lo, hi, frac) in places.items():
        if key not in missed:
            v_lo, v_hi = known[(*key, lo)], known[(*key, hi)]
            out[key] = (v_lo if lo == hi else v_lo + (v_hi - v_lo) * frac) + 0.0
    if missed:
        whole: dict[str, list[float]] = {}
        for m, p in missed:
            if p not in whole.setdefault(m, []):
                whole[m].append(p)
        for r in quantiles_from_ranks(rank_table(unpivot(wide, [], {m: m for m in whole}), partitions), whole).collect():
            out[r["metric"], r["p"]] = r["q"]
    return out


def bin_counts(df: DataFrame, cols: list[str], bins: int, label: str) -> DataFrame:
    """``(metric, bin, label, c)``: rows by their bin of each column, ceil(bins x average percentile rank), and their label.

    A rank grows with its value, so a bin ends at one value, the one at the place where the ranks pass it; the rows below
    and at it, counted exactly, tell on which side it falls.  No rank of a row is made or moved.  ``df``: no nulls, read a few times.
    """
    n = df.count()
    if not n or not cols:
        return _few(df.sparkSession, [], metric=pa.string(), bin=pa.int32(), **{label: pa.int64()}, c=pa.int64())
    rank_bin = lambda r: np.minimum(np.ceil(r / n * bins), bins)            # as in the ranks, in doubles
    ends = []
    for b in range(1, bins):
        r = min(n, int(n * b / bins) + 2)
        while r > 0 and rank_bin(float(r)) > b:
            r -= 1
        ends.append(r)                                      # ranks 1..r are in bins 1..b
    names = {c: f"m{i}" for i, c in enumerate(cols)}
    wide = df.select(*[F.col(c).cast("double").alias(names[c]) for c in cols], F.col(label).alias("label"))
    at_place = lambda r: r / max(1, n - 1)
    probs = {m: sorted({at_place(r) for r in ends if r < n}) for m in names.values()}
    values = _exact_quantiles(wide, probs, None, nearest=True) if ends else {}
    marks = [(i, b, r, values[m, at_place(r)]) for i, m in enumerate(names.values()) for b, r in enumerate(ends, 1) if r < n]

    def count(batches):
        """Per mark the rows below its value and at it."""
        total = np.zeros((len(marks), 2), dtype=np.int64)
        for batch in batches:
            own = [batch.column(m).to_numpy(zero_copy_only=False) for m in names.values()]
            for j, (i, _, _, x) in enumerate(marks):
                total[j] += [(own[i] < x).sum(), (own[i] == x).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(marks), dtype=np.int32)), *(pa.array(x) for x in total.T.copy())], names=["j", "below", "at"])

    sums = wide.mapInArrow(count, "j int, below long, at long").groupBy("j").agg(F.sum("below").alias("below"), F.sum("at").alias("at")).collect()
    sums = {r["j"]: (r["below"], r["at"]) for r in sums}                    # bins x columns
    edges: list[list[tuple[float, bool]]] = [[] for _ in cols]
    for j, (i, b, r, x) in enumerate(marks):
        below, at = sums[j]
        if not below <= r < below + at:
            raise AssertionError(f"{x} is not at place {r} of {cols[i]}")
        edges[i].append((x, bool(rank_bin(below + (at + 1) / 2.0) <= b)))

    def binned(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            own = [batch.column(m).to_numpy(zero_copy_only=False) for m in names.values()]
            labels, of = np.unique(y, return_inverse=True)
            for i, v in enumerate(own):
                at = np.zeros(len(v), dtype=np.int64)
                for x, inside in edges[i]:
                    at += (v > x) if inside else (v >= x)
                c = np.bincount(of * bins + at, minlength=len(labels) * bins).reshape(-1, bins)
                for k, label_ in enumerate(labels.tolist()):
                    found.setdefault(label_, np.zeros((len(cols), bins), dtype=np.int64))[i] += c[k]
        for label_, c in found.items():
            i, b = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([cols[k] for k in i], pa.string()), pa.array((b + 1).astype(np.int32)),
                                              pa.array(np.full(len(i), label_)).cast(pa.int64()), pa.array(c[i, b])], names=["metric", "bin", label, "c"])

    parts = wide.mapInArrow(binned, f"metric string, bin int, `{label}` long, c long")
    return parts.groupBy("metric", "bin", label).agg(F.sum("c").alias("c"))


def quantile_row(df: DataFrame, probs: dict[str, list[float]], exprs: dict[str, Column | str] | None = None,
                 name=lambda m, p: f"{m}_q{int(round(p * 100))}", partitions: int | None = None) -> DataFrame:
    """One-row DataFrame of quantiles, column per (metric, p) -- broadcastable."""
    exprs = exprs or {m: m for m in probs}
    wide, names = _numbers(df, {m: exprs[m] for m in probs})
    found = _exact_quantiles(wide, {names[m]: ps for m, ps in probs.items()}, partitions)
    cells = {name(m, p): found[names[m], float(p)] for m, ps in probs.items() for p in ps}
    return _few(df.sparkSession, [tuple(cells.values())], **dict.fromkeys(cells, pa.float64()))


def join_split_hot(long_df: DataFrame, table: DataFrame, keys: list[str], value_cols: list[str],
                   hot: Column) -> DataFrame:
    """Left-join ``table`` (unique ``keys``) onto ``long_df``; the rows of the
    keys marked ``hot`` (a predicate over ``table`` that selects a bounded set)
    go through a broadcast, the rest through a normal shuffle join -- a key
    holding a third of ``long_df`` never lands in one join task."""
    hot_t = table.where(hot).select(*keys, *value_cols).withColumn("_hot", F.lit(True))
    cold_t = table.where(~hot).select(*keys, *value_cols)
    tagged = long_df.join(F.broadcast(hot_t), keys, "left")
    via_hot = tagged.where(F.col("_hot")).drop("_hot")
    via_cold = (tagged.where(F.col("_hot").isNull()).drop("_hot", *value_cols)
                      .join(cold_t, keys, "left"))
    return via_hot.unionByName(via_cold)


def pct_ranks(df: DataFrame, id_col: str, metrics: dict[str, Column | str],
              partitions: int | None = None) -> DataFrame:
    """``(id_col, <metric>...)``: average-tie percentile rank of each metric.

    Equals pandas ``Series.rank(pct=True)`` (NULL input -> NULL rank).  Rank
    descending by passing the negated column.  Rows with the same id share the larger rank.
    ``partitions``: slices that a column is cut in.
    """
    wide, names = _numbers(df, {**metrics}, [id_col])
    cuts = partitions or min(SAMPLE // 16, max(CUTS, wide.count() // SLICE))
    names, cols = list(metrics), list(names.values())
    seen = _sampled(wide, cols)
    shares = np.arange(1, cuts) / cuts
    points = [np.unique(np.quantile(seen[c], shares, method="nearest")) if len(seen[c]) else np.zeros(0) for c in cols]      # at most cuts - 1 a metric
    width = 2 * cuts + 1

    def slices(batch, j: int) -> np.ndarray:
        """2 i: between points i - 1 and i; 2 i + 1: at point i; -1: no value."""
        v = batch.column(cols[j]).to_numpy(zero_copy_only=False).astype(np.float64)
        lo, hi = (np.searchsorted(points[j], v, side=side) for side in ("left", "right"))
        return np.where(np.isnan(v), -1, lo + hi)

    def count(batches):
        total = np.zeros((len(cols), width), dtype=np.int64)
        for batch in batches:
            for j in range(len(cols)):
                at = slices(batch, j)
                total[j] += np.bincount(at[at >= 0], minlength=width)
        j, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[j, at])], names=["metric", "slice", "c"])

    sizes = np.zeros((len(cols), width), dtype=np.int64)
    counted = wide.select(*cols).mapInArrow(count, "metric int, slice int, c long")
    for r in counted.groupBy("metric", "slice").agg(F.sum("c").alias("c")).collect():          # metrics x slices
        sizes[r["metric"], r["slice"]] = r["c"]
    before, n = np.cumsum(sizes, 1) - sizes, sizes.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at_point = (before + (sizes + 1) / 2.0) / n[:, None]

    def equal(batches):
        """The ranks of the rows that hold a cut."""
        for batch in batches:
            out = [batch.column(id_col)]
            for j in range(len(cols)):
                at = slices(batch, j)
                out.append(pa.array(at_point[j][at], mask=(at < 0) | (at % 2 == 0)))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, *cols])

    def between(batches):
        """The other rows, long: their metric, slice, value and the rows below the slice."""
        for batch in batches:
            for j in range(len(cols)):
                at = slices(batch, j)
                own = np.flatnonzero((at >= 0) & (at % 2 == 0))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_col).take(pa.array(own)), pa.array(np.full(len(own), j, dtype=np.int32)), pa.array(at[own].astype(np.int32)),
                         pa.array(batch.column(cols[j]).to_numpy(zero_copy_only=False)[own] + 0.0), pa.array(before[j][at[own]])],
                        names=[id_col, "metric", "slice", "value", "off"])

    id_type = wide.schema[id_col].dataType.simpleString()

    def placed(group: pa.Table) -> pa.Table:
        """The ranks of the rows of a slice."""
        v, j = group.column("value").to_numpy(), group.column("metric")[0].as_py()
        _, at, c = np.unique(v, return_inverse=True, return_counts=True)
        pct = (group.column("off")[0].as_py() + np.cumsum(c) - c + (c + 1) / 2.0) / n[j]
        return pa.table([group.column(id_col), group.column("metric"), pa.array(pct[at])], names=[id_col, "metric", "pct"])

    rows = wide.mapInArrow(between, f"`{id_col}` {id_type}, metric int, slice int, value double, off long") \
        .groupBy("metric", "slice").applyInArrow(placed, f"`{id_col}` {id_type}, metric int, pct double") \
        .select(id_col, *[F.when(F.col("metric") == j, F.col("pct")).alias(c) for j, c in enumerate(cols)])
    known = wide.select(id_col, *cols).mapInArrow(equal, f"`{id_col}` {id_type}, " + ", ".join(f"{c} double" for c in cols))
    return known.unionByName(rows).groupBy(id_col).agg(*[F.max(c).alias(m) for c, m in zip(cols, names)])

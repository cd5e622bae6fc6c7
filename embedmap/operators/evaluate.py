"""Cluster quality and comparison of clusterings and maps (EVAL*, CMP*)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.cluster import map_axes
from embedmap.operators.knn import knn_join
from embedmap.operators.ranking import uniform_sample
from embedmap.operators.sets import neighbor_overlap
from embedmap.session import store

MEAN_BLOCK = 1024
SCORE_PARTS = 8  # blocks of rows that are scored, more only where they would pass SCORE_ROWS
SCORE_ROWS = 2**18
TILE = (64, 1024)  # rows of both sides whose distances are held at a time, so that they stay in the cache


def distance_sums(left: list[np.ndarray], right: list[np.ndarray], weight: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Per row of the left side the (weighted) sum of its distances to each group of right rows, which begin at ``first``.

    Both sides are given as one array per axis.
    """
    out = np.zeros((len(left[0]), len(first)))
    size = len(right[0])
    own, other = np.empty(TILE), np.empty(TILE)
    for lo in range(0, size, TILE[1]):
        hi = min(lo + TILE[1], size)
        groups = slice(np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi))
        cuts = np.maximum(first[groups] - lo, 0)
        for s in range(0, len(out), TILE[0]):
            e = min(s + TILE[0], len(out))
            d, g = own[: e - s, : hi - lo], other[: e - s, : hi - lo]
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                np.subtract(x[s:e, None], y[lo:hi], out=g if k else d)
                if k:
                    np.multiply(g, g, out=g)
                    d += g
                else:
                    np.multiply(d, d, out=d)
            np.sqrt(d, out=d)
            if weight is not None:
                d *= weight[lo:hi]
            out[s:e, groups] += np.add.reduceat(d, cuts, axis=1)
    return out


def silhouette(points: DataFrame, cluster: str = "cluster", sample: int | None = None, seed: int = 42) -> DataFrame:
    """One row: mean silhouette with plain euclidean distances on the map axes.

    All rows are scored, or a fixed sample if the caller gives its size. Rows are cut into few large blocks,
    every two blocks are a task and only distance sums per cluster leave it. The exact score compares all
    rows, so a large map calls for a sample.
    """
    axes = map_axes(points)
    rows = points.select(F.col("ls_index").cast("long"), F.col(cluster).cast("int").alias("c"), *[F.col(a).cast("double").alias(a) for a in axes])
    if sample is not None:
        rows = uniform_sample(rows, sample, seed)
    rows = store(rows, "scored-rows")
    n = rows.count()
    parts = max(1, min(SCORE_PARTS, n // MEAN_BLOCK), -(-n // SCORE_ROWS))
    part = F.pmod(F.xxhash64("ls_index"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select(part.alias("l"), every.alias("r"), "*", F.lit(True).alias("asks"))
    right = rows.select(every.alias("l"), part.alias("r"), "*", F.lit(False).alias("asks")).filter("c IS NOT NULL")
    pair = (F.col("l") * parts + F.col("r")).alias("pair")
    pairs = left.unionByName(right).select(pair, "ls_index", "c", *axes, "asks").repartitionById(parts * parts, F.col("pair"))

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        asks = table.column("asks")
        lt, rt = table.filter(asks).combine_chunks(), table.filter(pc.invert(asks)).combine_chunks().sort_by("c")
        del table, batches
        if not lt.num_rows or not rt.num_rows:
            return
        field = lambda t, c: t.column(c).to_numpy()
        labels, first = np.unique(field(rt, "c"), return_index=True)
        lv, rv = ([field(t, a) for a in axes] for t in (lt, rt))
        step = max(64, min(4096, 2**22 // len(labels)))
        for s in range(0, lt.num_rows, step):
            sums = distance_sums([x[s : s + step] for x in lv], rv, None, first)
            at, own = pa.array(np.repeat(np.arange(len(sums)), len(labels))), lt.slice(s, len(sums)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    *[own.column(c).combine_chunks().take(at) for c in ("ls_index", "c")],
                    pa.array(np.tile(labels, len(sums)).astype(np.int32)),
                    pa.array(sums.ravel()),
                ],
                names=["ls_index", "own", "other", "total"],
            )

    sums = pairs.mapInArrow(run, "ls_index long, own int, other int, total double")
    sums = sums.groupBy("ls_index", "own", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n"))
    mine = F.col("own") == F.col("other")
    per = sums.join(sizes, "other").groupBy("ls_index").agg(
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("own_n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    labels = F.count_if(F.col("b").isNull()) > 0
    return per.agg(
        F.when(labels, F.lit(None)).otherwise(F.round(F.avg(score), 4)).alias("silhouette"), F.count("*").alias("scored")
    )


def _means(points: DataFrame, cluster: str) -> tuple[list[str], DataFrame]:
    axes = map_axes(points)
    cents = points.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes])
    return axes, store(cents, "centroids")


def calinski_harabasz(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: between to within dispersion. Two levels of variance, no join needed."""
    axes = map_axes(points)
    per = points.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes], *[F.var_pop(a).alias(f"s_{a}") for a in axes]
    )
    n = F.col("n")
    grand = {a: F.sum(n * F.col(f"m_{a}")) / F.sum(n) for a in axes}
    within = sum((F.sum(n * F.col(f"s_{a}")) for a in axes), F.lit(0.0))
    # sum of n*(m-g)^2 as n*m^2 - N*g^2, on the small table of clusters
    between = sum((F.sum(n * F.col(f"m_{a}") ** 2) - F.sum(n) * grand[a] ** 2 for a in axes), F.lit(0.0))
    k = F.count("*")
    score = F.try_divide(between / (k - 1), within / (F.sum(n) - k))
    return per.agg(F.round(F.when(F.sum(n) > k, score), 2).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: mean over clusters of the worst (s_i + s_j) / d_ij."""
    axes, cents = _means(points, cluster)
    gap = sum(((F.col(a) - F.col(f"m_{a}")) ** 2 for a in axes), F.lit(0.0))
    rows = points.select(F.col(cluster).alias("c"), *axes).join(cents, "c")
    spread = rows.groupBy("c").agg(F.avg(F.sqrt(gap)).alias("s"), *[F.first(f"m_{a}").alias(f"m_{a}") for a in axes])
    spread = store(spread, "spread")
    # clusters, not rows, are compared: lists of about MEAN_BLOCK clusters meet every cluster once
    parts = max(1, -(-spread.count() // MEAN_BLOCK))
    lists = spread.groupBy(F.pmod(F.xxhash64("c"), F.lit(parts)).alias("block")).agg(
        F.collect_list(F.struct("c", "s", *[f"m_{a}" for a in axes])).alias("others")
    )
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block")

    def ratio(o) -> Column:
        d = F.sqrt(sum(((F.col(f"m_{a}") - o[f"m_{a}"]) ** 2 for a in axes), F.lit(0.0)))
        return F.when(o["c"] == F.col("c"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("s") + o["s"], d), F.lit(0.0)))

    met = spread.select("*", ids).join(lists, "block")
    worst = met.groupBy("c").agg(F.max(F.array_max(F.transform("others", ratio))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 4).alias("davies_bouldin"))


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, n): rows per pair of clusters; inputs are (ls_index, cluster)."""
    a = left.select("ls_index", F.col("cluster").alias("l"))
    b = right.select("ls_index", F.col("cluster").alias("r"))
    return a.join(b, "ls_index").groupBy("l", "r").agg(F.count("*").alias("n"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and normalized mutual information (arithmetic mean)."""
    cells = contingency(left, right)
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    ent = lambda df: F.struct(
        F.sum(pairs(F.col("t"))).alias("p"), F.sum(F.col("t") * F.log("t")).alias("e"), F.sum("t").alias("t"), F.count("*").alias("k")
    )
    side = lambda key: cells.groupBy(key).agg(F.sum("n").cast("double").alias("t")).agg(ent(None)).scalar()
    row = cells.agg(F.sum(pairs(n)).alias("p"), F.sum(n * F.log(n)).alias("e"), F.sum(n).alias("t"))
    row = row.withColumn("L", side("l")).withColumn("R", side("r"))
    row = row.select(
        "p", "e", "t", *[F.col(f"{s}.{f}").alias(f"{s}{f}") for s in "LR" for f in ("p", "e", "k")]
    )
    t, lp, rp = F.col("t"), F.col("Lp"), F.col("Rp")
    expected = F.try_divide(lp * rp, pairs(t))
    ari = F.try_divide(F.col("p") - expected, (lp + rp) / 2 - expected)
    h = lambda e: F.log(t) - F.col(e) / t
    mutual = h("Le") + h("Re") - h("e")
    nmi = F.try_divide(mutual, (h("Le") + h("Re")) / 2)
    single = (F.col("Lk") == 1) & (F.col("Rk") == 1)
    return row.select(
        F.round(F.coalesce(ari, F.lit(1.0)), 4).alias("ari"),
        F.round(F.when(single, 1.0).otherwise(F.coalesce(F.greatest(nmi, F.lit(0.0)), F.lit(0.0))), 4).alias("nmi"),
    )


def equivalence_map(cells: DataFrame) -> DataFrame:
    """For each left cluster the right cluster it overlaps most, ties to the lowest id."""
    best = F.max_by("r", F.struct(F.col("n"), -F.col("r")))
    return cells.groupBy("l").agg(best.alias("best"))


def changed_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose right cluster is not the equivalent of their left cluster."""
    match = store(equivalence_map(contingency(left, right)), "cluster-match")
    a = left.select("ls_index", F.col("cluster").alias("l"))
    b = right.select("ls_index", F.col("cluster").alias("r"))
    return a.join(b, "ls_index").join(match, "l").filter(F.col("r") != F.col("best")).select("ls_index", "l", "r")


# --- comparing two maps -------------------------------------------------------------------


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Scale a column to [0, 1] by its extent; a constant column becomes 0.

    The rows are stored first, so that whatever made them runs once for the extent and the rows.
    """
    df = store(df, "scores")
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    constant = lo is None or lo == hi
    return df.withColumn(column, F.col(column) * 0.0 if constant else (F.col(column) - lo) / (hi - lo))


def _shift(left: DataFrame, right: DataFrame) -> DataFrame:
    axes = [a for a in map_axes(left) if a in right.columns]
    b = right.select("ls_index", *[F.col(a).alias(f"_{a}") for a in axes])
    gap = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in axes), F.lit(0.0))
    return left.join(b, "ls_index").select("ls_index", F.sqrt(gap).alias("score"))


def map_displacement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distance each row moved between two maps, scaled to [0, 1]."""
    return min_max(_shift(left, right), "score")


def map_neighbors(points: DataFrame, k: int) -> DataFrame:
    """The k nearest map points of every row, itself included."""
    axes = map_axes(points)
    at = points.select("ls_index", F.array(*[F.col(a).cast("double") for a in axes]).alias("vector"))
    return knn_join(at, at, k)


def map_neighborhood(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """1 - Jaccard overlap of each row's neighbours in two maps, scaled to [0, 1]."""
    both = neighbor_overlap(map_neighbors(left, k), map_neighbors(right, k))
    score = 1 - F.col("n_common") / F.col("n_union")
    return min_max(both.select("ls_index", score.alias("score")), "score")


def map_relative(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """How far a row's move differs from the mean move of its left-map neighbours."""
    moved = _shift(left, right)
    near = map_neighbors(left, k).select("ls_index", "neighbor")
    around = near.join(moved.withColumnsRenamed({"ls_index": "neighbor", "score": "s"}), "neighbor")
    mean = around.groupBy("ls_index").agg(F.avg("s").alias("mean"))
    out = moved.join(mean, "ls_index").select("ls_index", F.abs(F.col("score") - F.col("mean")).alias("score"))
    return min_max(out, "score")

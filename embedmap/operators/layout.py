"""Neighbour-graph layout (PRJ2): uniform manifold approximation as DataFrame jobs.

The graph and its objective follow the published method (arXiv:1802.03426). The optimizer differs:
instead of updating points one sampled edge at a time it applies, per epoch, the expected
attraction of all edges at once and a fixed number of hashed repulsion partners per point.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.knn import knn_join, matrix
from embedmap.operators.project import normalize_frame
from embedmap.operators.ranking import assign_row_index
from embedmap.session import store

# fixed values: force clipping, the scale of the start map, and the least stiffness of a point
CLIP, START_SCALE, SOFT = 4.0, 10.0, 0.03
BLOCKS = 4  # blocks of the rows of a layout, more only where one would pass BLOCK_ROWS; every two meet in a task
BLOCK_ROWS = 2**20
EDGE_SLICE = 2**18  # edges whose forces are held at a time
FORCES = "p long, fx double, fy double, h double"


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1/(1+a d^(2b)) fitted to the wanted fall-off by Gauss-Newton."""
    x = np.linspace(1e-3, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        p = x ** (2 * b)
        f = 1 / (1 + a * p)
        jac = np.stack([-(f**2) * p, -(f**2) * a * p * 2 * np.log(x)], axis=1)
        step = np.linalg.lstsq(jac, y - f, rcond=None)[0]
        a, b = max(1e-3, a + step[0]), max(1e-3, b + step[1])
    return float(a), float(b)


def _memberships(near: DataFrame, k: int) -> DataFrame:
    """(ls_index, neighbor, w): local similarity with each point's own scale."""
    # k entries per row, so the lists are bounded
    lists = near.groupBy("ls_index").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("_l")
    ).select(
        "ls_index", F.transform("_l", lambda e: e["neighbor"]).alias("ids"), F.transform("_l", lambda e: e["distance"]).alias("d")
    )
    target = math.log2(k)

    def run(batches):
        for b in batches:
            sizes = b.column("d").value_lengths().to_numpy(zero_copy_only=False)
            d = np.full((len(sizes), k), np.inf)
            mask = np.arange(k)[None] < sizes[:, None]
            d[mask] = b.column("d").flatten().to_numpy(zero_copy_only=False)
            positive = np.where(d > 0, d, np.inf).min(1)
            rho = np.where(np.isfinite(positive), positive, 0.0)
            gap = np.maximum(d - rho[:, None], 0.0)
            lo, hi = np.zeros(len(d)), np.full(len(d), np.inf)
            mid = np.ones(len(d))
            for _ in range(64):
                total = np.exp(-gap / np.maximum(mid, 1e-12)[:, None]).sum(1)
                high = total > target
                hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
                mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
                mid = np.minimum(mid, 1e12)
            w = np.exp(-gap / np.maximum(mid, 1e-12)[:, None])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            weights = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w[mask]))
            yield pa.RecordBatch.from_arrays(
                [b.column("ls_index"), b.column("ids"), weights], names=["ls_index", "ids", "w"]
            )

    scaled = lists.mapInArrow(run, "ls_index long, ids array<long>, w array<double>")
    pair = F.explode(F.arrays_zip("ids", "w")).alias("e")
    return scaled.select("ls_index", pair).select("ls_index", F.col("e.ids").alias("neighbor"), F.col("e.w").alias("w"))


def fuzzy_graph(vectors: DataFrame, k: int = 15, metric: str = "cosine", near: DataFrame | None = None) -> DataFrame:
    """Undirected edges (a, b, w) with a < b: w = p + q - pq of the two directed similarities.

    ``near`` may be a ready neighbour table, such as that of ``neighbor_descent``.
    """
    if near is None:
        near = knn_join(vectors, vectors, k, metric, include_self=False)
    directed = _memberships(near.filter(F.col("rank") <= k), k)
    ends = directed.select(F.least("ls_index", "neighbor").alias("a"), F.greatest("ls_index", "neighbor").alias("b"), "w")
    # one or two entries per pair
    both = ends.groupBy("a", "b").agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count("*").alias("n"))
    w = F.when(F.col("n") == 2, F.col("s") - F.col("lo") * F.col("hi")).otherwise(F.col("s"))
    return both.select("a", "b", w.alias("w"))


def _limit(c: Column) -> Column:
    return F.when(c > CLIP, CLIP).when(c < -CLIP, -CLIP).otherwise(c)


def _dealt(links: DataFrame, blocks: int) -> DataFrame:
    """(cell, i, j, w, twin) in lists of bounded size, kept where the blocks of both ends meet, for all epochs."""
    cell = F.pmod("i", F.lit(blocks)) * blocks + F.pmod("j", F.lit(blocks))
    pieces = math.ceil(links.count() / (blocks * blocks * EDGE_SLICE / 16)) or 1
    piece = F.pmod(F.xxhash64("i", "j", "twin"), F.lit(pieces))
    lists = links.groupBy(cell.alias("cell"), piece.alias("piece")).agg(F.collect_list(F.struct("i", "j", "w", "twin")).alias("e"))
    lists = lists.select("cell", *[F.col(f"e.{c}").alias(c) for c in ("i", "j", "w", "twin")])
    return lists.repartition(_tasks(blocks), "cell").sortWithinPartitions("cell").persist(StorageLevel.DISK_ONLY)


def _tasks(blocks: int) -> int:
    # cells are dealt by hash; with some room few share a task
    return 3 * blocks * blocks


def _summed(at: pa.Table, rows: pa.Table, cell: int, blocks: int, a: float, b: float) -> pa.Table:
    """Forces on the rows of one block by edges to, and hashed partners in, another."""
    mine, theirs = divmod(cell, blocks)
    p, x, y, deg = (rows.column(c).to_numpy() for c in ("p", "x", "y", "deg"))
    n = int(p.max()) // blocks + 1

    def placed(block: int) -> np.ndarray:
        out, own = np.zeros((n, 3)), p % blocks == block
        out[p[own] // blocks] = np.stack((x[own], y[own], deg[own]), axis=1)
        return out

    left = placed(mine)
    right = left if mine == theirs else placed(theirs)
    force = np.zeros((3, n))

    def add(i: np.ndarray, fx: np.ndarray, fy: np.ndarray, h: np.ndarray | None = None) -> None:
        for k, f in enumerate((fx, fy, h)):
            if f is not None:
                force[k] += np.bincount(i, f, minlength=n)

    def apart(i: np.ndarray, j: np.ndarray):
        dx, dy = left[i, 0] - right[j, 0], left[i, 1] - right[j, 1]
        d2 = dx * dx + dy * dy
        return dx, dy, d2, 1.0 + a * d2**b

    i_all, j_all, w_all, twin_all = (at.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("i", "j", "w", "twin"))
    for s in range(0, len(i_all), EDGE_SLICE):
        i, j, w, twin = (c[s : s + EDGE_SLICE] for c in (i_all, j_all, w_all, twin_all))
        i, j = i // blocks, j // blocks
        dx, dy, d2, fall = apart(i, j)
        edge = np.where(d2 > 0, 2.0 * a * b * np.where(d2 > 0, d2, 1.0) ** (b - 1) / fall, 0.0)
        stiff = w * np.where(twin, np.maximum(left[i, 2], SOFT), edge)
        add(i, -stiff * dx, -stiff * dy, stiff)
    far = rows.column("far").combine_chunks()
    i_all = np.repeat(p // blocks, far.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    j_all = far.flatten().to_numpy(zero_copy_only=False) // blocks
    for s in range(0, len(i_all), EDGE_SLICE):
        i, j = i_all[s : s + EDGE_SLICE], j_all[s : s + EDGE_SLICE]
        dx, dy, d2, fall = apart(i, j)
        push = 2.0 * b / ((0.001 + d2) * fall)
        add(i, left[i, 2] * np.clip(push * dx, -CLIP, CLIP), left[i, 2] * np.clip(push * dy, -CLIP, CLIP))
    own = p[p % blocks == mine]
    fx, fy, h = force[:, own // blocks]
    return pa.table({"p": own, "fx": fx, "fy": fy, "h": h})


def run_epochs(state: DataFrame, links: DataFrame, rows: int, epochs: int, min_dist: float, repel: int, blocks: int | None = None) -> DataFrame:
    """``state`` (p, x, y, deg, first, rows) after all epochs; p counts from 0, and a row's partners are among ``rows`` from ``first``.

    ``links`` is (i, j, w, twin) in both directions; a twin pulls with the weight of all edges of i. Rows are cut into few blocks, and edges
    are dealt once to the pairs of blocks they lie between. In an epoch rows are sent to the pairs of their block, and forces
    come back summed per row and pair, so edges are not shuffled again. Positions are stored each epoch: plans stay small and a lost executor costs one epoch.
    """
    a, b = curve(min_dist)
    blocks = blocks or max(BLOCKS, math.ceil(rows / BLOCK_ROWS))
    dealt = _dealt(links, blocks)
    own, every = F.pmod("p", F.lit(blocks)), F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    cells = F.array_union(F.transform(every, lambda r: own * blocks + r), F.transform(every, lambda l: l * blocks + own))

    def run(key: tuple, at: pa.Table, near: pa.Table) -> pa.Table:
        # a pair of blocks without rows has no edges
        return _summed(at, near, key[0].as_py(), blocks, a, b)

    try:
        for epoch in range(epochs):
            rate = 1.0 - epoch / epochs
            partner = lambda s: F.col("first") + F.pmod(F.xxhash64("p", F.lit(epoch), s), F.col("rows"))  # noqa: E731, B023
            partners = F.transform(F.sequence(F.lit(1), F.lit(repel)), partner)
            sent = state.select("p", "x", "y", "deg", partners.alias("far"), F.explode(cells).alias("cell"))
            met = F.filter("far", lambda j: (F.pmod(j, F.lit(blocks)) == F.pmod("cell", F.lit(blocks))) & (j != F.col("p")))
            far = F.when((F.col("cell") - F.pmod("cell", F.lit(blocks)) == own * blocks) & (F.size(met) > 0), met)
            sent = sent.select("cell", "p", "x", "y", "deg", far.alias("far")).repartition(_tasks(blocks), "cell")
            force = dealt.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, FORCES)
            force = force.groupBy("p").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "h")])
            # scaled by the stiffness of a point's edges: all edges act at once, a full step would overshoot
            shift = lambda f, rate=rate: rate * _limit(F.coalesce(F.col(f) / (F.col("h") + SOFT), F.lit(0.0)))
            moved = state.join(force, "p", "left")
            state = store(moved.select("p", (F.col("x") + shift("fx")).alias("x"), (F.col("y") + shift("fy")).alias("y"), "deg", "first", "rows"), "layout-state")
    finally:
        dealt.unpersist()
    return state


def graph_layout(
    vectors: DataFrame, start: DataFrame, k: int = 15, epochs: int = 30, min_dist: float = 0.1, repel: int = 5, metric: str = "cosine",
    near: DataFrame | None = None,
) -> DataFrame:
    """(ls_index, x, y) in [-1, 1]: the neighbour graph laid out from a start map; ``near`` as in ``fuzzy_graph``."""
    edges = fuzzy_graph(vectors, k, metric, near)
    dense = assign_row_index(start.select("ls_index", "x", "y"), [F.col("ls_index")], "p")
    dense = store(dense, "layout-ids")
    rows = dense.count()
    ids = dense.select("ls_index", "p")
    num = edges.join(ids.withColumnsRenamed({"ls_index": "a", "p": "i"}), "a").join(ids.withColumnsRenamed({"ls_index": "b", "p": "j"}), "b")
    num = store(num.select("i", "j", "w").union(num.select("j", "i", "w")), "layout-edges")
    degree = num.groupBy("i").agg(F.sum("w").alias("deg"))
    state = store(dense.select("p", (F.col("x") * START_SCALE).alias("x"), (F.col("y") * START_SCALE).alias("y")).join(
        degree.withColumnRenamed("i", "p"), "p", "left").fillna(0.0, ["deg"]).withColumns({"first": F.lit(0).cast("long"), "rows": F.lit(rows).cast("long")}), "layout-state")
    state = run_epochs(state, num.withColumn("twin", F.lit(False)), rows, epochs, min_dist, repel)
    placed = state.join(ids, "p").select("ls_index", "x", "y")
    return normalize_frame(placed, ["x", "y"])


def place_by_layout(
    old_map: DataFrame, old_vectors: DataFrame, new_vectors: DataFrame, k: int = 15, epochs: int = 30, min_dist: float = 0.1, repel: int = 5, metric: str = "cosine"
) -> DataFrame:
    """(ls_index, x, y): the old map as it is, and new rows placed in it by the layout's objective (PRJ10).

    New rows begin at the weighted mean of their ``k`` nearest old rows. In each epoch these attract them
    and hashed old rows push them away, while old rows stay where they are. So a row between two groups ends with one of them,
    where a mean leaves it in the empty space between. Rows that are in the map already, and those without
    old neighbours, are not placed.
    """
    a, b = curve(min_dist)
    fixed = store(assign_row_index(old_map.select("ls_index", "x", "y"), [F.col("ls_index")], "p"), "fixed-rows")
    fixed = fixed.select("ls_index", "p", (F.col("x") * START_SCALE).alias("jx"), (F.col("y") * START_SCALE).alias("jy"))
    rows = fixed.count()
    new = new_vectors.join(fixed.select("ls_index"), "ls_index", "left_anti")
    near = knn_join(new, old_vectors.join(fixed.select("ls_index"), "ls_index", "left_semi"), k, metric)
    pulls = _memberships(near, k).withColumnsRenamed({"ls_index": "i", "neighbor": "ls_index"}).join(fixed, "ls_index")
    pulls = store(pulls.select("i", "jx", "jy", "w"), "pulls")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    state = store(pulls.groupBy("i").agg(mean("jx").alias("x"), mean("jy").alias("y"), F.sum("w").alias("deg")), "placed-rows")
    dx, dy = F.col("x") - F.col("jx"), F.col("y") - F.col("jy")
    d2 = dx * dx + dy * dy
    fall = 1.0 + a * F.pow(d2, F.lit(b))
    stiff = F.col("w") * F.when(d2 > 0, 2.0 * a * b * F.pow(d2, F.lit(b - 1)) / fall).otherwise(0.0)
    push = 2.0 * b / ((0.001 + d2) * fall)
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        attract = pulls.join(state, "i").select("i", (-stiff * dx).alias("fx"), (-stiff * dy).alias("fy"), stiff.alias("h"))
        partner = F.pmod(F.xxhash64("i", F.lit(epoch), F.col("s")), F.lit(rows))
        others = state.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(repel)))).withColumn("p", partner).join(fixed, "p")
        others = others.select("i", (F.col("deg") * _limit(push * dx)).alias("fx"), (F.col("deg") * _limit(push * dy)).alias("fy"), F.lit(0.0).alias("h"))
        force = attract.union(others).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "h")])
        shift = lambda f, rate=rate: rate * _limit(F.coalesce(F.col(f) / (F.col("h") + SOFT), F.lit(0.0)))
        state = store(state.join(force, "i", "left").select("i", (F.col("x") + shift("fx")).alias("x"), (F.col("y") + shift("fy")).alias("y"), "deg"), "placed-rows")
    placed = state.select(F.col("i").alias("ls_index"), (F.col("x") / START_SCALE).alias("x"), (F.col("y") / START_SCALE).alias("y"))
    return old_map.select("ls_index", "x", "y").unionByName(placed)

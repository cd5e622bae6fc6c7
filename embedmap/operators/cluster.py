"""Clustering of maps and vectors (CLU*)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.knn import knn_join, matrix, squared
from embedmap.operators.ranking import assign_row_index
from embedmap.session import cut_lineage, store

MAP_AXES = ("x", "y", "z")


def map_axes(df: DataFrame) -> list[str]:
    return [a for a in MAP_AXES if a in df.columns]


def _renumber(df: DataFrame, raw: str, noise: Column | None = None) -> DataFrame:
    """Cluster numbers by falling size, then lowest member; noise becomes -1."""
    rows = df if noise is None else df.filter(~noise)
    sizes = rows.groupBy(raw).agg(F.count("*").alias("_n"), F.min("ls_index").alias("_first"))
    order = assign_row_index(sizes, [F.col("_n").desc(), F.col("_first").asc()], "_id").select(raw, "_id")
    order = store(order, "cluster-numbers")
    numbered = df.join(order, raw, "left")
    return numbered.select("ls_index", F.coalesce(F.col("_id"), F.lit(-1)).cast("int").alias("raw_cluster"))


def _points(points: DataFrame) -> DataFrame:
    """(ls_index, features) from a map or from vectors."""
    axes = map_axes(points)
    v = F.array(*[F.col(a).cast("double") for a in axes]) if axes else F.col("vector").cast("array<double>")
    return points.select("ls_index", array_to_vector(v).alias("features"))


def _seeds(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on a sample: each next centre is drawn by its squared distance to those before."""
    chosen = [sample[rng.integers(len(sample))]]
    gap = squared(sample, chosen[0][None])[:, 0]
    for _ in range(k - 1):
        chosen.append(sample[rng.choice(len(sample), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(sample))])
        gap = np.minimum(gap, squared(sample, chosen[-1][None])[:, 0])
    return np.array(chosen)


def _nearest(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(v, centers)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


def kmeans(points: DataFrame, k: int, seed: int = 42, starts: int = 10, max_iter: int = 100, tol: float = 1e-4, seeding: int = 10_000) -> DataFrame:
    """k-means, the best of several starts by cost; never any noise.

    All starts move together: a round is one pass over the rows, in which every task sums up its rows
    per start and centre. Starts begin at k-means++ centres of a sample of at least ``seeding`` distinct
    rows, the same at every size, and stop when their centres move less than ``tol`` of the variance.
    """
    axes = map_axes(points)
    v = F.array(*[F.col(a).cast("double") for a in axes]) if axes else F.col("vector").cast("array<double>")
    data = store(points.select(F.col("ls_index").cast("long"), v.alias("v")), "features")
    drawn = data.select("v").distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(max(seeding, 20 * k))
    sample = np.array([r.v for r in drawn.collect()])
    if not len(sample):
        return data.select("ls_index", F.lit(0).alias("raw_cluster"))
    k, dims = min(k, len(sample)), sample.shape[1]
    rng = np.random.default_rng(seed)
    centers = np.array([_seeds(sample, k, rng) for _ in range(starts)])
    still, costs = np.ones(starts, bool), np.full(starts, np.inf)
    sums = ", ".join(f"s{j} double" for j in range(dims))

    def moved(active: np.ndarray) -> DataFrame:
        def run(batches):
            total = np.zeros((len(active), k, dims + 2))
            for b in batches:
                m = matrix(b.column("v"))
                for i, s in enumerate(active):
                    at, gap = _nearest(m, centers[s])
                    np.add.at(total[i], at, np.concatenate((np.ones((len(m), 1)), gap[:, None], m), axis=1))
            flat = total.reshape(-1, dims + 2)
            start, c = np.divmod(np.arange(len(flat)), k)
            columns = [pa.array(active[start]), pa.array(c), *[pa.array(flat[:, j]) for j in range(dims + 2)]]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "c", "n", "cost", *[f"s{j}" for j in range(dims)]])

        parts = data.select("v").mapInArrow(run, f"start long, c long, n double, cost double, {sums}")
        return parts.groupBy("start", "c").agg(*[F.sum(x).alias(x) for x in ("n", "cost", *[f"s{j}" for j in range(dims)])])

    spread = sample.var(0).sum()
    for _ in range(max_iter):
        active = np.flatnonzero(still)
        if not len(active):
            break
        new = centers.copy()
        costs[active] = 0
        for r in moved(active).collect():  # one row per start and centre
            costs[r.start] += r.cost
            if r.n:
                new[r.start, r.c] = np.array(r[4:]) / r.n
        still[active] = ((new[active] - centers[active]) ** 2).sum(2).max(1) > tol * spread
        centers = new
    best = centers[int(costs.argmin())]

    def label(batches):
        for b in batches:
            at, _ = _nearest(matrix(b.column("v")), best)
            yield pa.RecordBatch.from_arrays([b.column("ls_index"), pa.array(at.astype(np.int32))], names=["ls_index", "_c"])

    return _renumber(data.mapInArrow(label, "ls_index long, _c int"), "_c")


def gmm(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    model = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="_c").fit(_points(points))
    return _renumber(model.transform(_points(points)).drop("probability"), "_c")


def column_clusters(df: DataFrame, column: str) -> DataFrame:
    """A table column as cluster ids; values that are not integers are ranked first."""
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return df.select("ls_index", F.col(column).cast("int").alias("raw_cluster"))
    values = assign_row_index(df.select(column).distinct(), [F.col(column).asc()], "_id")
    ranked = df.select("ls_index", column).join(values, df[column].eqNullSafe(values[column]))
    return ranked.select("ls_index", F.col("_id").cast("int").alias("raw_cluster"))


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (a, p) links to their end by doubling; every link points to a smaller id."""
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("p2"))
        step = parents.join(up, "p", "left").select("a", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved"))
        step = store(step, "roots")
        parents = step.drop("moved")
        if step.filter("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the lowest node id reachable over undirected edges (a, b).

    Each round every node hangs under its smallest neighbour, the trees are flattened by doubling
    and the graph is contracted to their roots. Every component with an edge merges with another,
    so rounds are logarithmic in the number of nodes and edges shrink on the way. Each round ends
    in stored tables, so plans and their size estimates do not grow with the rounds.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    graph = store(both.filter("a <> b").distinct(), "graph")
    state = nodes.select("node", F.col("node").alias("component"))
    while not graph.isEmpty():
        parents = graph.groupBy("a").agg(F.min("b").alias("p")).filter("p < a")
        roots = _roots(parents)
        at_a, at_b = roots.withColumnRenamed("p", "pa"), roots.withColumnsRenamed({"a": "b", "p": "pb"})
        graph = graph.join(at_a, "a", "left").join(at_b, "b", "left")
        graph = graph.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        graph = store(graph.filter("a <> b").distinct(), "graph")
        move = roots.withColumnsRenamed({"a": "component"})
        state = store(state.join(move, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "state")
    return state


def _cell_of(axes: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(a) / F.lit(side)).cast("long") for a in axes])


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Cell shifts that can hold a point within eps, for cells of side eps/sqrt(dims)."""
    reach = math.ceil(math.sqrt(dims))
    shifts = itertools.product(range(-reach, reach + 1), repeat=dims)
    # gap between two cells along an axis is (|s|-1) sides; eps is sqrt(dims) sides
    return [s for s in shifts if any(s) and sum(max(abs(o) - 1, 0) ** 2 for o in s) <= dims]


def _shifted(cell: Column, offsets: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.array(*[cell[i] + o for i, o in enumerate(s)]) for s in offsets])


def density_clusters(
    points: DataFrame, min_cluster_size: int = 5, min_samples: int = 5, eps: float = 0.05
) -> DataFrame:
    """DBSCAN* on the map: core points within eps of each other share a cluster, rest is noise.

    Cells have side eps/sqrt(d), so all points of a cell are within eps. A cell of at least
    ``min_samples`` rows is all core without looking at distances, and the core points of a cell
    are one node of the graph. Points are compared only for sparse cells (each has fewer than
    ``min_samples`` rows) and between sub-cells whose bounding boxes leave the link undecided.
    """
    axes = map_axes(points)
    dims, side = len(axes), eps / math.sqrt(len(axes))
    offsets = _offsets(dims)
    # equal points are one weighted point
    spots = points.groupBy(*axes).agg(F.count("*").alias("w"), F.min("ls_index").alias("spot"))
    spots = spots.withColumn("cell", _cell_of(axes, side))
    weight = spots.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    spots = cut_lineage(spots.join(weight, "cell"))

    def near2(a: str, b: str) -> Column:
        return sum(((F.col(f"{a}_{x}") - F.col(f"{b}_{x}")) ** 2 for x in axes), F.lit(0.0))

    def named(df: DataFrame, p: str, *extra: str) -> DataFrame:
        return df.select("cell", *[F.col(x).alias(f"{p}_{x}") for x in axes], *extra)

    # 1. core points: dense cells by count, sparse cells by looking around
    sparse = spots.filter(F.col("cell_w") < min_samples)
    looks = sparse.select(
        F.explode(_shifted(F.col("cell"), offsets)).alias("cell"), "spot", *[F.col(x).alias(f"p_{x}") for x in axes]
    )
    around = looks.join(named(spots, "q", "w"), "cell").filter(near2("p", "q") <= eps * eps)
    counted = around.groupBy("spot").agg(F.sum("w").alias("more"))
    core_sparse = sparse.join(counted, "spot", "left").filter(
        F.col("cell_w") + F.coalesce("more", F.lit(0)) >= min_samples
    )
    core = spots.filter(F.col("cell_w") >= min_samples).unionByName(core_sparse.select(*spots.columns))
    core = cut_lineage(core.select("spot", "cell", *axes))

    # 2. a cell's core points are one node, named by its lowest row id
    nodes = core.groupBy("cell").agg(F.min("spot").alias("node"))
    # 3. links between neighbouring cells, decided on the boxes of 8-way sub-cells where possible
    sub = F.array(*[F.floor(F.col(x) / F.lit(side / 8)).cast("long") for x in axes])
    boxes = core.withColumn("sub", sub).groupBy("cell", "sub").agg(
        *[F.min(x).alias(f"{x}0") for x in axes], *[F.max(x).alias(f"{x}1") for x in axes]
    ).join(nodes, "cell")
    half = [s for s in offsets if s > tuple([0] * dims)]
    names = [f"{x}{e}" for x in axes for e in (0, 1)]
    left = boxes.select(
        F.explode(_shifted(F.col("cell"), half)).alias("cell"), F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"),
        F.col("node").alias("a"), *[F.col(n).alias(f"l{n}") for n in names]
    )
    right = boxes.select("cell", F.col("sub").alias("sub_b"), F.col("node").alias("b"), *[F.col(n).alias(f"r{n}") for n in names])
    far = sum((F.greatest(F.col(f"l{x}1") - F.col(f"r{x}0"), F.col(f"r{x}1") - F.col(f"l{x}0")) ** 2 for x in axes), F.lit(0.0))
    gap = sum(
        (F.greatest(F.col(f"l{x}0") - F.col(f"r{x}1"), F.col(f"r{x}0") - F.col(f"l{x}1"), F.lit(0.0)) ** 2 for x in axes),
        F.lit(0.0),
    )
    judged = cut_lineage(
        left.join(right, "cell")
        .select("cell_a", "sub_a", F.col("cell").alias("cell_b"), "sub_b", "a", "b", (far <= eps * eps).alias("sure"), (gap <= eps * eps).alias("may"))
        .filter("may")
    )
    sure = judged.filter("sure").select("a", "b").distinct()
    open_ = judged.join(sure, ["a", "b"], "left_anti")
    subs = core.withColumn("sub", sub)
    lp = subs.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), *[F.col(x).alias(f"p_{x}") for x in axes])
    rp = subs.select(F.col("cell").alias("cell_b"), F.col("sub").alias("sub_b"), *[F.col(x).alias(f"q_{x}") for x in axes])
    checked = (
        open_.select("cell_a", "sub_a", "cell_b", "sub_b", "a", "b")
        .join(lp, ["cell_a", "sub_a"])
        .join(rp, ["cell_b", "sub_b"])
        .filter(near2("p", "q") <= eps * eps)
    )
    edges = sure.union(checked.select("a", "b").distinct())
    comps = connected_components(edges, nodes.select("node"))

    # 4. rows of core points take their cell's component; small components are noise
    cell_comp = nodes.join(comps, "node").select("cell", "component")
    placed = core.join(cell_comp, "cell").select(*axes, "component")
    rows = points.select("ls_index", *axes).join(placed, axes, "left").select("ls_index", "component")
    return _drop_small(rows, min_cluster_size)


def _drop_small(rows: DataFrame, min_cluster_size: int) -> DataFrame:
    """Components under the size limit become noise; the rest is numbered by size."""
    big = rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.count("*").alias("_size"))
    big = big.filter(F.col("_size") >= min_cluster_size)
    marked = rows.join(big, "component", "left")
    return _renumber(marked.select("ls_index", "component", "_size"), "component", F.col("_size").isNull())


def graph_clusters(vectors: DataFrame, k: int = 15, min_cluster_size: int = 5, metric: str = "cosine", near: DataFrame | None = None) -> DataFrame:
    """Components of the mutual k-nearest-neighbour graph in embedding space.

    ``near`` may be a ready neighbour table, such as that of ``neighbor_descent``. ``community_clusters``
    tells topics apart that a few edges link.
    """
    if near is None:
        near = knn_join(vectors, vectors, k, metric, include_self=False)
    near = store(near.filter(F.col("rank") <= k).select("ls_index", "neighbor"), "near")
    back = near.select(F.col("neighbor").alias("ls_index"), F.col("ls_index").alias("neighbor"))
    mutual = near.join(back, ["ls_index", "neighbor"]).filter("ls_index < neighbor")
    edges = mutual.select(F.col("ls_index").alias("a"), F.col("neighbor").alias("b"))
    comps = connected_components(edges, vectors.select(F.col("ls_index").alias("node")))
    return _drop_small(comps.withColumnRenamed("node", "ls_index"), min_cluster_size)


def cluster_space(
    method: str, granularity: str, points: DataFrame, vectors: DataFrame | None, on: str | None = None
) -> tuple[str, DataFrame]:
    """Which table a method clusters: vectors for the graph method by default, else the map."""
    on = on or ("embedding" if method == "graph" else "map")
    if on not in ("embedding", "map", "column"):
        raise ValueError(f"cannot cluster on {on}")
    if granularity == "tokens" and (on != "map" or method == "column"):
        raise ValueError("token maps can only be clustered on the map")
    if on == "embedding":
        if vectors is None:
            raise ValueError("clustering on embeddings needs vectors")
        return on, vectors.select("ls_index", "vector")
    return on, points.select("ls_index", *map_axes(points))


def noise_to_unclustered(raw: DataFrame) -> DataFrame:
    """Noise becomes one extra cluster after the highest real id (0 if nothing is real)."""
    top = raw.filter(F.col("raw_cluster") != -1).agg(F.max("raw_cluster")).first()[0]
    extra = F.lit(0 if top is None else top + 1)
    return raw.withColumn("cluster", F.when(F.col("raw_cluster") == -1, extra).otherwise(F.col("raw_cluster")))


def noise_to_nearest(points: DataFrame) -> DataFrame:
    """Noise joins the cluster with the nearest centroid, ties to the lowest id.

    Without real clusters noise becomes one cluster 0.
    """
    axes = map_axes(points)
    real = points.filter(F.col("raw_cluster") != -1)
    cents = store(real.groupBy("raw_cluster").agg(*[F.avg(a).alias(a) for a in axes]), "centroids")
    if cents.isEmpty():
        return points.withColumn("cluster", F.lit(0))
    v = F.array(*axes).alias("vector")
    noise = points.filter(F.col("raw_cluster") == -1).select("ls_index", v)
    near = knn_join(noise, cents.select(F.col("raw_cluster").cast("long").alias("ls_index"), v), 1)
    near = near.select("ls_index", F.col("neighbor").cast("int").alias("_near"))
    joined = points.join(near, "ls_index", "left")
    return joined.withColumn("cluster", F.coalesce("_near", "raw_cluster")).drop("_near")


def default_labels(clusters: DataFrame) -> DataFrame:
    """Label and description per cluster; the noise cluster says so."""
    per = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.bool_or(F.col("raw_cluster") == -1).alias("_noise"))
    number, size = F.col("cluster").cast("string"), F.col("n").cast("string")
    return per.select(
        "cluster",
        F.when(F.col("_noise"), "Unclustered").otherwise(F.concat(F.lit("Cluster "), number)).alias("label"),
        F.when(
            F.col("_noise"), F.concat(size, F.lit(" noise points the clustering algorithm did not assign to any cluster."))
        )
        .otherwise(F.concat(F.lit("This is cluster "), number, F.lit(" with "), size, F.lit(" items.")))
        .alias("description"),
    )


def _outer(pts: np.ndarray) -> np.ndarray:
    """Positions of all points but those strictly inside the polygon of 16 directional extremes."""
    angle = np.arange(16) * (np.pi / 8)
    tips = pts[np.argmax(pts @ np.stack((np.cos(angle), np.sin(angle))), axis=0)]
    ahead = np.roll(tips, -1, axis=0)
    if (tips == tips[0]).all():
        return np.arange(len(pts))
    inside = np.ones(len(pts), bool)
    for (ax, ay), (bx, by) in zip(tips, ahead, strict=True):
        if (ax, ay) != (bx, by):
            inside &= (bx - ax) * (pts[:, 1] - ay) - (by - ay) * (pts[:, 0] - ax) > 1e-12
    return np.flatnonzero(~inside)


def _hull_ids(pdf: pd.DataFrame) -> np.ndarray:
    """Positions of the hull vertices, counter-clockwise from the lowest (x, y)."""
    pts = pdf[["x", "y"]].to_numpy()
    # most points lie inside a few extremes; only the others go through the loop
    order = _outer(pts)
    order = order[np.lexsort((pdf["ls_index"].to_numpy()[order], pts[order, 1], pts[order, 0]))]
    # of equal points only the lowest id can be a vertex
    same = np.r_[False, (np.diff(pts[order], axis=0) == 0).all(1)] if len(order) > 1 else np.array([False])
    order = order[~same]
    if len(order) < 3:
        return order

    def chain(seq):
        out = []
        for i in seq:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = pts[out[-2]], pts[out[-1]], pts[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def cluster_hulls(points: DataFrame, cluster: str = "raw_cluster", spread: int = 64) -> DataFrame:
    """(cluster, pos, ls_index): convex hull vertices of each cluster on x, y; noise has none.

    Every batch first keeps only its own hull per cluster, then those candidates are merged in
    two steps, so no task ever holds a whole cluster. Clusters with fewer than three rows or
    without area have no hull.
    """
    schema = "cluster int, ls_index long, x double, y double"
    rows = points.filter(F.col(cluster) >= 0).select(
        F.col(cluster).cast("int").alias("cluster"), F.col("ls_index").cast("long"),
        F.col("x").cast("double"), F.col("y").cast("double"),
    )

    def local(batches):
        for pdf in batches:
            for _, part in pdf.groupby("cluster"):
                yield part.iloc[_hull_ids(part)]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[_hull_ids(pdf)][["cluster", "ls_index", "x", "y"]]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = _hull_ids(pdf)
        if len(ids) < 3:
            ids = ids[:0]
        out = pdf.iloc[ids]
        return pd.DataFrame({"cluster": out["cluster"], "pos": np.arange(len(out)), "ls_index": out["ls_index"]})

    kept = rows.mapInPandas(local, schema).withColumn("salt", F.pmod(F.xxhash64("ls_index"), F.lit(spread)))
    merged = kept.groupBy("cluster", "salt").applyInPandas(merge, schema)
    return merged.groupBy("cluster").applyInPandas(final, "cluster int, pos int, ls_index long")


def hull_points(hulls: DataFrame, scope: DataFrame) -> DataFrame:
    """Hull vertices with coordinates, deleted rows left out."""
    live = scope.filter(~F.col("deleted")).select("ls_index", "x", "y")
    return hulls.join(live, "ls_index").select("cluster", "pos", "ls_index", "x", "y")


def hull_anchors(vertices: DataFrame) -> DataFrame:
    """Per hull the vertex mean (label anchor) and its topmost vertex."""
    top = F.max_by(F.struct("ls_index", "x", "y"), F.struct(F.col("y"), -F.col("ls_index")))
    return vertices.groupBy("cluster").agg(
        F.avg("x").alias("anchor_x"), F.avg("y").alias("anchor_y"), top.alias("_t")
    ).select(
        "cluster", "anchor_x", "anchor_y", F.col("_t.ls_index").alias("top_id"),
        F.col("_t.x").alias("top_x"), F.col("_t.y").alias("top_y"),
    )


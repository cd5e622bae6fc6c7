"""Density clusters of unequal density (CLU3): a merge tree of the neighbour graph, cut by excess of mass.

The graph links every point to its nearest ones; an edge weighs the mutual reachability of its ends,
the largest of their distance and their two core distances. Raising the weight lets components
merge. Where two components of at least ``min_cluster_size`` points merge, two clusters end and a
new one begins; all other merges only add points to a cluster. Of nested clusters those are chosen whose
points stay together over the widest range of density (arXiv:1705.07321).

The tree of all merges is never built in one place. Edges are split at a middle weight again and again:
the lighter half is one problem, the heavier half another in which components of the lighter are
single nodes. Problems of bounded size are then solved by themselves, each telling only what happens in
its range of weights. What is put together on one task is the table of clusters, at most two rows
for ``min_cluster_size`` points and a row for each change of a cluster's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from embedmap.operators.cluster import _renumber, _roots, connected_components, map_axes
from embedmap.operators.knn import knn_join
from embedmap.session import cut_lineage, store

PROBLEM_EDGES = 200_000
ID_BITS = 40  # row ids lie below this power of two, problems above
LEAST = 1e-9  # weights below count as this, so that equal points have a density

STEPS = "kind string, w double, child long, parent long, size long, big int"


def neighbor_edges(points: DataFrame, min_samples: int, neighbors: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) between distinct places, and (spot, size, axes) of the places; a place is named by its lowest row id."""
    axes = map_axes(points)
    spots = points.select("ls_index", *axes).dropna().groupBy(*axes).agg(F.count("*").alias("size"), F.min("ls_index").alias("spot"))
    spots = store(spots.select("spot", "size", *axes), "spots")
    vectors = spots.select(F.col("spot").alias("ls_index"), F.array(*[F.col(a).cast("double") for a in axes]).alias("vector"))
    near = store(knn_join(vectors, vectors, neighbors, include_self=False), "near-spots")
    sized = near.join(spots.select(F.col("spot").alias("neighbor"), "size"), "neighbor")
    # at most ``neighbors`` rows in a window
    nearer = W.partitionBy("ls_index").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    summed = sized.withColumn("upto", F.sum("size").over(nearer)).join(spots.select(F.col("spot").alias("ls_index"), F.col("size").alias("own")), "ls_index")
    enough = summed.filter(F.col("own") + F.col("upto") >= min_samples).groupBy("ls_index").agg(F.min("distance").alias("far"))
    core = spots.join(enough.withColumnRenamed("ls_index", "spot"), "spot", "left")
    core = store(core.select("spot", F.when(F.col("size") >= min_samples, 0.0).otherwise(F.col("far")).alias("core")).dropna(), "core-distances")
    at = lambda end: core.select(F.col("spot").alias(end), F.col("core").alias(f"core_{end}"))
    both = near.select(F.least("ls_index", "neighbor").alias("a"), F.greatest("ls_index", "neighbor").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("d"))
    edges = both.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    return store(edges, "reach-edges"), spots


def _node(prob: str, node: str) -> Column:
    return F.shiftleft(F.col(prob).cast("long"), ID_BITS).bitwiseOR(F.col(node))


def _problems(edges: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(prob, a, b, w) and (prob, node, size): independent problems of at most ``most`` edges, or of one weight."""
    edges, sizes = edges.withColumn("prob", F.lit(0)), sizes.withColumn("prob", F.lit(0))
    done_edges, done_sizes = [], []
    while True:
        cuts = edges.groupBy("prob").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile_approx("w", 0.5).alias("mid"))
        cuts = store(cuts.select("prob", ((F.col("n") > most) & (F.col("lo") < F.col("hi"))).alias("split"), "mid", "hi"), "cuts")
        split = cuts.filter("split")
        done_edges.append(edges.join(split, "prob", "left_anti"))
        done_sizes.append(sizes.join(split, "prob", "left_anti"))
        if split.isEmpty():
            break
        light = F.when(F.col("mid") < F.col("hi"), F.col("w") <= F.col("mid")).otherwise(F.col("w") < F.col("mid"))
        sided = edges.join(split, "prob").withColumn("light", light)
        lower = store(sided.filter("light").select("prob", "a", "b", "w"), "lighter")
        linked = lower.select(_node("prob", "a").alias("a"), _node("prob", "b").alias("b"))
        ends = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        found = connected_components(linked, ends)
        low = F.lit((1 << ID_BITS) - 1).cast("long")
        named = found.select(F.shiftright("node", ID_BITS).cast("int").alias("prob"), F.col("node").bitwiseAND(low).alias("node"), F.col("component").bitwiseAND(low).alias("into"))
        named = store(named, "contracted")
        at = lambda end: named.select("prob", F.col("node").alias(end), F.col("into").alias(f"into_{end}"))
        upper = sided.filter("NOT light").select("prob", "a", "b", "w").join(at("a"), ["prob", "a"], "left").join(at("b"), ["prob", "b"], "left")
        one, other = F.coalesce("into_a", "a"), F.coalesce("into_b", "b")
        upper = upper.filter(one != other).groupBy("prob", F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).agg(F.min("w").alias("w"))
        own = sizes.join(split.select("prob"), "prob").join(named, ["prob", "node"], "left")
        below = own.filter("into IS NOT NULL").select((2 * F.col("prob") + 1).alias("prob"), "node", "size")
        above = own.groupBy("prob", F.coalesce("into", "node").alias("node")).agg(F.sum("size").alias("size"))
        edges = store(lower.withColumn("prob", 2 * F.col("prob") + 1).unionByName(upper.withColumn("prob", 2 * F.col("prob") + 2)), "problem-edges")
        sizes = store(below.unionByName(above.withColumn("prob", 2 * F.col("prob") + 2).select("prob", "node", "size")), "problem-sizes")
    out_edges, out_sizes = done_edges[0], done_sizes[0]
    for e, s in zip(done_edges[1:], done_sizes[1:], strict=True):
        out_edges, out_sizes = out_edges.unionByName(e.select(out_edges.columns)), out_sizes.unionByName(s.select(out_sizes.columns))
    return out_edges, out_sizes


def _merges(edges: pd.DataFrame, sizes: pd.DataFrame, least: int) -> pd.DataFrame:
    """What happens in one problem, edges of equal weight at once.

    Components bear the name of their lowest member. Rows: p, a small component joins another and stays
    small; e, a small one becomes part of a big one; m, a big one begins (big = 0), changes its name (1) or
    merges with others.
    """
    size = dict(zip(sizes["node"].tolist(), sizes["size"].tolist(), strict=True))
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while top in up:
            top = up[top]
        while x != top:
            up[x], x = top, up[x]
        return top

    out = []
    edges = edges.sort_values("w", kind="stable")
    weights = edges["w"].to_numpy()
    pairs = list(zip(edges["a"].tolist(), edges["b"].tolist(), strict=True))
    starts = np.flatnonzero(np.r_[True, weights[1:] != weights[:-1]]) if len(weights) else []
    for lo, hi in zip(starts, [*starts[1:], len(weights)], strict=True):
        w, before = float(weights[lo]), set()
        for a, b in pairs[lo:hi]:
            a, b = find(a), find(b)
            if a != b:
                before.update((a, b))
        for a, b in pairs[lo:hi]:
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        groups: dict[int, list[int]] = {}
        for x in before:
            groups.setdefault(find(x), []).append(x)
        for name, children in groups.items():
            total = sum(size[x] for x in children)
            big = sum(size[x] >= least for x in children)
            if total >= least and big == 0:
                out.append(("m", w, None, name, total, 0))
            for x in children:
                if total < least:
                    if x != name:
                        out.append(("p", w, x, name, size[x], 0))
                elif size[x] < least:
                    out.append(("e", w, x, name, size[x], 0))
                elif big > 1 or x != name:
                    out.append(("m", w, x, name, size[x], big))
            size[name] = total
    return pd.DataFrame(out, columns=["kind", "w", "child", "parent", "size", "big"]).astype({"child": "Int64", "parent": "Int64", "size": "int64", "big": "int32"})


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """(name, since, cluster, up, start, held): clusters by the names they bear, since which weight.

    ``up`` is the cluster it becomes part of (-1: none), ``start`` the weight at which it began,
    ``held`` the points that its parts brought in.
    """
    rows = rows.sort_values(["w", "parent", "child"], kind="stable")
    now: dict[int, int] = {}
    start, held, up, names = [], [], [], []
    for (w, name), part in rows.groupby(["w", "parent"], sort=False):
        if part["big"].iloc[0] == 1:
            now[name] = now[int(part["child"].iloc[0])]
        else:
            new = len(start)
            start.append(w)
            up.append(-1)
            held.append(0)
            if part["big"].iloc[0] > 1:
                for child, n in zip(part["child"], part["size"], strict=True):
                    up[now[int(child)]] = new
                    held[new] += n
            now[name] = new
        names.append((int(name), w, now[name]))
    at = [c for _, _, c in names]
    columns = {"name": [n for n, _, _ in names], "since": [s for _, s, _ in names], "cluster": at}
    return pd.DataFrame(columns | {"up": [up[c] for c in at], "start": [start[c] for c in at], "held": [held[c] for c in at]})


def _density(w: Column | np.ndarray) -> Column | np.ndarray:
    return 1.0 / (F.greatest(w, F.lit(LEAST)) if isinstance(w, Column) else np.maximum(w, LEAST))


def _choice(clusters: pd.DataFrame) -> pd.DataFrame:
    """(cluster, chosen): the chosen cluster that holds each cluster, if any; the whole is never chosen.

    Clusters come as (cluster, up, start, held, mass, points): the points that join a cluster by
    themselves, and the sum of their densities.
    """
    t = clusters.sort_values(["start", "cluster"]).set_index("cluster")
    born = t["up"].map(t["start"])
    birth = np.where(t["up"] < 0, 0.0, _density(born.fillna(1.0).to_numpy()))
    t["mass"] = t["mass"] - birth * t["points"] + t["held"] * (_density(t["start"].to_numpy()) - birth)
    below = dict.fromkeys(t.index, 0.0)
    tops = int((t["up"] < 0).sum())
    own: dict[int, bool] = {}
    # a cluster begins at a greater weight than its parts, so those come first
    for c, up, mass in zip(t.index, t["up"], t["mass"], strict=True):
        own[c] = mass >= below[c] and not (up < 0 and tops == 1)
        if up >= 0:
            below[up] += max(mass, below[c])
    chosen: dict[int, int | None] = {}
    for c, up in reversed(list(zip(t.index, t["up"], strict=True))):
        above = chosen.get(up)
        chosen[c] = above if above is not None else (c if own[c] else None)
    out = [(c, k) for c, k in chosen.items() if k is not None]
    return pd.DataFrame(out, columns=["cluster", "chosen"]).astype("int64")


def _alone(df: DataFrame, run, schema: str) -> DataFrame:
    """A function of a small table as a whole, on one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield run(pd.concat(parts, ignore_index=True))

    return df.coalesce(1).mapInPandas(rows, schema)


def _as_of(events: DataFrame, tree: DataFrame) -> DataFrame:
    """(spot, w, size, cluster): the cluster that is called ``parent`` at the weight of an event.

    The name of the largest cluster has most events and most clusters, whose pairs grow with the square of the points. So
    both are put in order of name and weight and cut into ranges; a range that begins within a name takes over its last cluster.
    """
    named = tree.select(F.col("name").alias("parent"), F.col("since").alias("w"), F.lit(0).alias("late"), "cluster", F.lit(None).cast("long").alias("spot"), F.lit(None).cast("long").alias("size"))
    rows = named.unionByName(events.select("parent", "w", F.lit(1).alias("late"), F.lit(None).cast("long").alias("cluster"), "spot", "size"))
    cut = cut_lineage(rows.repartitionByRange("parent", "w", "late").withColumn("_range", F.spark_partition_id()))
    upto = W.partitionBy("_range", "parent").orderBy("w", "late", "cluster").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_own", F.last("cluster", ignorenulls=True).over(upto)).filter("late = 1")
    ends = cut.groupBy("_range", "parent").agg(F.max(F.when(F.col("late") == 0, F.struct("w", "cluster"))).alias("e"))
    # one row per range of a name, so at most the number of partitions in one window
    before = W.partitionBy("parent").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_range", "parent", F.last("e.cluster", ignorenulls=True).over(before).alias("_before"))
    found = local.join(carried, ["_range", "parent"]).select("spot", "w", "size", F.coalesce("_own", "_before").alias("cluster"))
    return found.filter("cluster IS NOT NULL")


def hierarchical_clusters(
    points: DataFrame, min_cluster_size: int = 5, min_samples: int = 5, neighbors: int | None = None, problem_edges: int = PROBLEM_EDGES
) -> DataFrame:
    """(ls_index, raw_cluster): clusters of a map without a global distance; -1 is noise.

    The core distance of a point is the least radius that holds ``min_samples`` points, itself
    included. Points are linked to their ``neighbors`` nearest other places (twice ``min_samples``,
    16 at least); parts of the map without a link between them merge last, at density zero. Equal points are
    one place of their number. Rows without a position and clusters of fewer than
    ``min_cluster_size`` points are noise, as is everything if nothing ever splits. The result does
    not depend on ``problem_edges``.
    """
    neighbors = neighbors or max(16, 2 * min_samples)
    axes = map_axes(points)
    edges, spots = neighbor_edges(points, min_samples, neighbors)
    sizes = spots.select(F.col("spot").alias("node"), "size")
    e, s = _problems(edges, sizes, problem_edges)
    steps = e.groupBy("prob").cogroup(s.join(e.select("prob").distinct(), "prob", "left_semi").groupBy("prob"))
    steps = steps.applyInPandas(lambda a, b: _merges(a, b, min_cluster_size), STEPS)
    # places of many equal points are clusters from the start
    alone = sizes.filter(F.col("size") >= min_cluster_size)
    begun = alone.select(F.explode(F.array(F.lit("m"), F.lit("e"))).alias("kind"), F.lit(0.0).alias("w"), F.when(F.col("kind") == "e", F.col("node")).alias("child"), F.col("node").alias("parent"), "size", F.lit(0).alias("big"))
    steps = store(steps.unionByName(begun), "merge-steps")

    tree = _alone(steps.filter("kind = 'm'").select("w", "child", "parent", "size", "big"), _tree, "name long, since double, cluster long, up long, start double, held long")
    tree = store(tree, "cluster-tree")
    events = steps.filter("kind = 'e'").select(F.col("child").alias("spot"), "parent", "w", "size")
    joined = store(_as_of(events, tree), "joined-points")
    mass = joined.groupBy("cluster").agg(F.sum(F.col("size") * _density(F.col("w"))).alias("mass"), F.sum("size").alias("points"))
    clusters = tree.select("cluster", "up", "start", "held").distinct().join(mass, "cluster", "left").fillna(0)
    chosen = store(_alone(clusters, _choice, "cluster long, chosen long"), "chosen")

    links = _roots(steps.filter("kind = 'p'").select(F.col("child").alias("a"), F.col("parent").alias("p")))
    placed = spots.join(links.select(F.col("a").alias("spot"), "p"), "spot", "left").withColumn("name", F.coalesce("p", "spot"))
    placed = placed.join(joined.select(F.col("spot").alias("name"), "cluster"), "name").join(chosen, "cluster").select(*axes, "chosen")
    rows = points.select("ls_index", *axes).join(placed, axes, "left").select("ls_index", "chosen")
    return _renumber(rows, "chosen", F.col("chosen").isNull())

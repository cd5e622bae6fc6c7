"""Communities of a weighted graph on several levels (CLU4), by moves that raise modularity.

In a sweep half of the nodes, drawn by hash, look at the communities of their neighbours and move to the one
with the largest gain: the weight of their edges into it, less what chance would put there. When
sweeps raise modularity no more, communities become nodes, their edges are added up, and the
next level begins (arXiv:0803.0476). Each level is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.operators.cluster import _drop_small
from embedmap.operators.knn import knn_join
from embedmap.session import store

GAIN = 1e-9


def modularity(both: DataFrame, state: DataFrame, resolution: float = 1.0) -> float:
    """Of (node, c) on (a, b, w) that holds each edge in both directions, a loop once with twice its weight."""
    at = lambda end: state.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"))
    placed = both.join(at("a"), "a").join(at("b"), "b")
    per = placed.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return r.inside / r.m2 - resolution * r.kk / r.m2**2 if r.m2 else 0.0


def _moved(both: DataFrame, state: DataFrame, m2: float, resolution: float, turn: int) -> DataFrame:
    """(node, c, k, inside, total): the communities after one sweep over (node, c, k), k a node's weight.

    ``inside`` is the weight of a node's edges into its community before the sweep, ``total`` that community's weight, so the
    same pass over the edges tells the modularity before the sweep.
    """
    total = state.groupBy("c").agg(F.sum("k").alias("total"))
    placed = state.select("node", "c", "k").join(total, "c")
    near = both.filter("a <> b").join(placed.select(F.col("node").alias("b"), "c", "total"), "b")
    into = near.repartition("a").groupBy(F.col("a").alias("node"), F.col("c").alias("to")).agg(F.sum("w").alias("w"), F.max("total").alias("rest"))
    turns = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    gain = lambda w, rest: w - resolution * F.col("k") * rest / m2
    offer = F.when(F.col("to") != F.col("c"), F.struct(gain(F.col("w"), F.col("rest")).alias("g"), (-F.col("to")).alias("c")))
    inside = F.sum(F.when(F.col("to") == F.col("c"), F.col("w")).otherwise(0.0)).alias("inside")
    found = placed.join(into, "node", "left").groupBy("node", "c", "k", "total").agg(inside, F.max(offer).alias("other"))
    # staying is an offer as well, also for a node without an edge into its community
    stay = F.struct((gain(F.col("inside"), F.col("total") - F.col("k")) + GAIN).alias("g"), (-F.col("c")).alias("c"))
    moved = F.when(turns, -F.greatest(stay, F.coalesce("other", stay))["c"]).otherwise(F.col("c"))
    return found.select("node", moved.alias("c"), "k", "inside", "total")


def community_levels(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, sweeps: int = 20, most: int = 20) -> DataFrame:
    """(node, level, community): communities of (a, b, w) over all (node), level 0 the finest.

    Edges are undirected and those of a pair are added up; loops, null ends and weights of 0 or less
    are left out. A community is named by its lowest node, each lies within one of the next level, and modularity
    rises from level to level. A larger ``resolution`` gives smaller communities. Nodes without an
    edge are communities of their own on every level. Ties go to the lower name.
    """
    whole = edges.filter("a <> b AND w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    both = store(whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "both-ways")
    place = store(nodes.select("node").distinct().withColumn("community", F.col("node")), "members")
    levels = []
    m2 = both.agg(F.sum("w")).first()[0] or 0.0
    while m2 and len(levels) < most:
        loops = both.filter("a = b").agg(F.sum("w")).first()[0] or 0.0
        state = store(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "communities")
        kept, start, best, idle = state, None, None, 0
        # a sweep tells the modularity of what it began with, so one more is made than is used
        for turn in range(sweeps + 1):
            later = store(_moved(both, state, m2, resolution, turn), "communities")
            r = later.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("total")).alias("kk")).first()
            now = (r.inside + loops) / m2 - resolution * r.kk / m2**2
            if start is None:
                start = best = now
            else:
                kept, best, idle = (state, now, 0) if now > best + GAIN else (kept, best, idle + 1)
            if idle == 2:  # either half of the nodes had its turn
                break
            state = later
        if best <= start + GAIN:
            break
        # named by the lowest node; the nodes of later levels are such names already
        lowest = kept.groupBy("c").agg(F.min("node").alias("low"))
        named = store(kept.join(lowest, "c").select("node", F.col("low").alias("c")), "named-communities")
        place = store(place.join(named.withColumnRenamed("node", "community"), "community", "left").select("node", F.coalesce("c", "community").alias("community")), "members")
        levels.append(place.withColumn("level", F.lit(len(levels))))
        at = lambda end, named=named: named.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"))
        both = store(both.join(at("a"), "a").join(at("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "both-ways")
    if not levels:
        levels = [place.withColumn("level", F.lit(0))]
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("node", "level", "community")


def community_clusters(
    vectors: DataFrame, k: int = 15, min_cluster_size: int = 5, level: int = -1, metric: str = "cosine", resolution: float = 1.0, near: DataFrame | None = None
) -> DataFrame:
    """(ls_index, raw_cluster): one level of communities of the mutual neighbour graph of the vectors, -1 the coarsest.

    Edges weigh the shared nearness of their ends, 1 for the nearest rank and falling with it. ``near`` may be a ready
    neighbour table, such as that of ``neighbor_descent``. Communities below ``min_cluster_size`` are noise.
    """
    if near is None:
        near = knn_join(vectors, vectors, k, metric, include_self=False)
    near = store(near.filter(F.col("rank") <= k).select("ls_index", "neighbor", ((k + 1 - F.col("rank")) / k).alias("w")), "near")
    back = near.select(F.col("neighbor").alias("ls_index"), F.col("ls_index").alias("neighbor"), F.col("w").alias("v"))
    mutual = near.join(back, ["ls_index", "neighbor"]).filter("ls_index < neighbor")
    edges = mutual.select(F.col("ls_index").alias("a"), F.col("neighbor").alias("b"), F.sqrt(F.col("w") * F.col("v")).alias("w"))
    found = store(community_levels(edges, vectors.select(F.col("ls_index").alias("node")), resolution), "levels")
    top = found.agg(F.max("level")).first()[0]
    if top is None:
        return found.select(F.col("node").alias("ls_index"), F.lit(-1).alias("raw_cluster"))
    wanted = max(0, min(level if level >= 0 else top + 1 + level, top))
    return _drop_small(found.filter(F.col("level") == wanted).select(F.col("node").alias("ls_index"), F.col("community").alias("component")), min_cluster_size)

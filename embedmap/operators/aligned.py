"""Layouts of several windows under one objective (PRJ9).

Each window has its own neighbour graph, and equal rows of near windows pull at each other, all in the same epochs.
Registration window by window can only turn and scale whole maps; here a topic keeps its place while the rest moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.operators.layout import START_SCALE, fuzzy_graph, run_epochs
from embedmap.operators.project import align_layouts, normalize_frame, project
from embedmap.operators.ranking import assign_row_index
from embedmap.session import store


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn("window", F.lit(i)) for i, p in enumerate(parts)])


def aligned_layouts(
    windows: list[DataFrame], k: int = 15, epochs: int = 30, pull: float = 0.5, reach: int = 2, min_dist: float = 0.1, repel: int = 5, metric: str = "cosine"
) -> DataFrame:
    """(window, ls_index, x, y) in one frame of [-1, 1], from (ls_index, vector) of each window.

    ``pull`` is the weight of a row's counterparts against that of its neighbours, halved for
    each window between them, up to ``reach`` windows away. Windows may hold different rows; one without
    counterparts is laid out beside the others. Forces are summed per row and epoch as in ``graph_layout``, and
    a row is pushed by hashed rows of its own window.
    """
    starts = align_layouts([project(w) for w in windows])
    dense = store(assign_row_index(starts.select("window", "ls_index", "x", "y"), [F.col("window"), F.col("ls_index")], "p"), "window-rows")
    ids = dense.select("window", "ls_index", "p")
    # one row per window: its first number and its rows
    sizes = store(dense.groupBy("window").agg(F.min("p").alias("first"), F.count("*").alias("rows")), "windows")
    graphs = _union([fuzzy_graph(w, k, metric) for w in windows])
    num = graphs.join(ids.withColumnsRenamed({"ls_index": "a", "p": "i"}), ["window", "a"]).join(ids.withColumnsRenamed({"ls_index": "b", "p": "j"}), ["window", "b"])
    num = store(num.select("i", "j", "w").union(num.select("j", "i", "w")), "window-edges")
    degree = num.groupBy(F.col("i").alias("p")).agg(F.sum("w").alias("deg"))
    state = dense.join(degree, "p", "left").join(sizes, "window")
    state = store(state.select("p", (F.col("x") * START_SCALE).alias("x"), (F.col("y") * START_SCALE).alias("y"), F.coalesce("deg", F.lit(0.0)).alias("deg"), "first", "rows"), "window-state")
    other = ids.withColumnsRenamed({"window": "_w", "p": "j"})
    apart = F.abs(F.col("window") - F.col("_w"))
    twins = ids.join(other, "ls_index").filter((apart > 0) & (apart <= reach)).select(F.col("p").alias("i"), "j", (pull * F.pow(F.lit(0.5), apart - 1)).alias("w"))
    # edges of both kinds in one table
    links = store(num.withColumn("twin", F.lit(False)).union(twins.withColumn("twin", F.lit(True))), "window-links")
    state = run_epochs(state, links, dense.count(), epochs, min_dist, repel)
    return normalize_frame(state.join(ids, "p").select("window", "ls_index", "x", "y"), ["x", "y"])

"""Vector search (VEC*)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.functions.vectors import EPS, l2_normalize
from embedmap.operators.knn import best_pairs, knn_join, match_blocks, matrix, squared
from embedmap.operators.ranking import top_per_group
from embedmap.operators.sets import candidate_union, ids_minus
from embedmap.session import scratch_path, store

MAX_DRIVER_QUERIES = 1024  # more queries than this are joined, not sent with the tasks


def _scan(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, limit: int, metric: str, vector: str) -> DataFrame:
    """(query, ls_index, distance): per Arrow batch the best rows of every query, in one pass.

    Distances are one matrix product per batch, and only ``limit`` rows of a batch leave the task.
    With the cosine metric a zero vector has no direction: it finds nothing and is not found.
    """
    cosine = metric == "cosine"
    q = np.asarray(q, dtype=np.float64)
    if cosine:
        size = np.sqrt((q * q).sum(1))
        ids, q = ids[size > 0], q[size > 0] / size[size > 0, None]

    def run(batches):
        for b in batches:
            v = matrix(b.column(vector))
            rows = b.column("ls_index").to_numpy(zero_copy_only=False)
            if cosine:
                n = np.sqrt((v * v).sum(1))
                v, rows = v[n > 0] / n[n > 0][:, None], rows[n > 0]
            if not len(v) or not len(q):
                continue
            for at, col, dist in best_pairs(q, v, limit, cosine, rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(rows[col]), pa.array(dist)],
                    names=["query", "ls_index", "distance"],
                )

    rows = vectors.select(F.col("ls_index").cast("long"), vector)
    return rows.mapInArrow(run, "query long, ls_index long, distance double")


def nn_search(
    vectors: DataFrame, query, limit: int = 150, metric: str = "cosine",
    scope: DataFrame | None = None, vector: str = "vector",
) -> DataFrame:
    """Exact nearest rows (ls_index, distance); only rows of ``scope`` if given."""
    rows = vectors.select("ls_index", vector)
    if scope is not None:
        rows = rows.join(scope.select("ls_index"), "ls_index", "left_semi")
    found = _scan(rows, np.array([0]), np.asarray(query, dtype=np.float64)[None], limit, metric, vector)
    return found.select("ls_index", "distance").orderBy("distance", "ls_index").limit(limit)


def nn_search_live(vectors: DataFrame, query, deleted: DataFrame, limit: int = 150, top: int = 20) -> DataFrame:
    """Search first, then drop deleted rows and keep the first few."""
    live = ids_minus(nn_search(vectors, query, limit), deleted)
    return live.orderBy("distance", "ls_index").limit(top)


def neighbors_of(points: DataFrame, point: int, k: int = 10, axes=("x", "y")) -> DataFrame:
    """The k nearest other points of one map point."""
    here = points.filter(F.col("ls_index") == point).agg(
        F.struct(*[F.first(a).alias(a) for a in axes])
    ).scalar()
    gap = sum(((F.col(a) - here.getField(a)) ** 2 for a in axes), F.lit(0.0))
    others = points.filter(F.col("ls_index") != point)
    return others.select("ls_index", F.sqrt(gap).alias("distance")).orderBy("distance", "ls_index").limit(k)


def closest_on_map(points: DataFrame, x: float, y: float, n: int = 10, reach: float = 0.05) -> DataFrame:
    """The n nearest points within ``reach`` per axis of a location."""
    box = points.filter(F.col("x").between(x - reach, x + reach) & F.col("y").between(y - reach, y + reach))
    dist = F.hypot(F.col("x") - x, F.col("y") - y).alias("distance")
    return box.select("ls_index", dist).orderBy("distance", "ls_index").limit(n)


def batch_search(
    queries: DataFrame, vectors: DataFrame, limit: int, metric: str = "cosine", vector: str = "vector"
) -> DataFrame:
    """(query, ls_index, distance, rank) for many queries (query, vector) in one pass.

    Few queries travel with the tasks and every batch keeps its best rows per query; more than
    MAX_DRIVER_QUERIES take the kNN join, which gives the same rows.
    """
    few = queries.select("query", vector).limit(MAX_DRIVER_QUERIES + 1).collect()
    if len(few) > MAX_DRIVER_QUERIES:
        left = queries.select(F.col("query").alias("ls_index"), vector)
        joined = knn_join(left, vectors, limit, metric, vector=vector)
        return joined.withColumnsRenamed({"ls_index": "query", "neighbor": "ls_index"})
    ids = np.array([r["query"] for r in few], dtype=np.int64)
    found = _scan(vectors, ids, np.array([r[vector] for r in few]), limit, metric, vector)
    return top_per_group(found, ["query"], ["distance", "ls_index"], limit)


def maxsim_scores(query_tokens, docs: DataFrame, tokens: str = "token_vectors") -> DataFrame:
    """(ls_index, score): per query token the best cosine with any document token, summed."""
    q = np.asarray(query_tokens, dtype=np.float64)
    q = q / (np.sqrt((q * q).sum(1, keepdims=True)) + EPS)

    def run(batches):
        for b in batches:
            lists = b.column(tokens)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros(len(counts))
            if counts.sum():
                t = matrix(lists.flatten())
                t = t / (np.sqrt((t * t).sum(1, keepdims=True)) + EPS)
                sims = t @ q.T
                full = counts > 0
                starts = (np.cumsum(counts) - counts)[full]
                out[full] = np.maximum.reduceat(sims, starts, axis=0).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("ls_index"), pa.array(out)], names=["ls_index", "score"])

    rows = docs.select(F.col("ls_index").cast("long"), tokens)
    return rows.mapInArrow(run, "ls_index long, score double")


def maxsim(query_tokens, docs: DataFrame, limit: int | None = None) -> DataFrame:
    scored = maxsim_scores(query_tokens, docs).orderBy(F.col("score").desc(), "ls_index")
    return scored if limit is None else scored.limit(limit)


def late_interaction_search(
    query_tokens, vectors: DataFrame, docs: DataFrame, prefilter: int | None = None, final: int = 50
) -> DataFrame:
    """The documents of best MaxSim; all are scored in one pass unless ``prefilter`` is given.

    With ``prefilter`` only that many nearest documents of the mean query, and a share of them for
    each query token, are candidates.
    """
    q = np.asarray(query_tokens, dtype=np.float64)
    if prefilter is None:
        return maxsim(q, docs, final)
    per_token = max(20, prefilter // max(1, len(q)))
    mean = nn_search(vectors, q.mean(0), prefilter)
    # number of query tokens is small and known, one row each
    asks = vectors.sparkSession.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(q)], "query long, vector array<double>"
    )
    each = batch_search(asks, vectors, per_token)
    candidates = candidate_union(mean, each)
    return maxsim(q, docs.join(candidates, "ls_index", "left_semi"), final)


@dataclass
class IvfIndex:
    """Vectors stored by coarse cell (a partition folder each), the cell centres and cell sizes."""

    path: str
    cells: DataFrame
    centers: np.ndarray
    sizes: np.ndarray


def with_direction(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor zero."""
    return vectors.filter(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))


def _unit(vectors: DataFrame) -> DataFrame:
    """Rows with a direction, and their unit vectors as ``features``."""
    return with_direction(vectors).select("ls_index", "vector", array_to_vector(l2_normalize("vector")).alias("features"))


def _place(vectors: DataFrame, centers: np.ndarray, path: str) -> None:
    """Append vectors to the folders of their nearest cells."""

    def run(batches):
        for b in batches:
            m = matrix(b.column("u"))
            near = [squared(m[s : s + 1024], centers).argmin(1) for s in range(0, len(m), 1024)]
            cell = pa.array(np.concatenate(near or [np.empty(0)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("ls_index"), b.column("vector"), cell], names=["ls_index", "vector", "cell"])

    rows = _unit(vectors).select(F.col("ls_index").cast("long"), F.col("vector").cast("array<float>"), l2_normalize("vector").alias("u"))
    placed = rows.mapInArrow(run, "ls_index long, vector array<float>, cell int")
    placed.write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def ivf_build(vectors: DataFrame, nlist: int = 256, path: str | None = None, seed: int = 42) -> IvfIndex:
    """Index of ``nlist`` k-means cells, fitted on all vectors and kept at ``path``.

    A cell is a folder, so a search reads only the folders it probes; inside, rows are spread over
    several files, so a hot cell is not one task's work. Zero vectors are not indexed.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "ivf")
    model = KMeans(k=nlist, seed=seed, featuresCol="features", predictionCol="cell").fit(store(_unit(vectors), "ivf-fit"))
    centers = np.array(model.clusterCenters())
    rows = [(i, c.tolist()) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    _place(vectors, centers, path)
    return ivf_open(spark, path)


def ivf_open(spark: SparkSession, path: str) -> IvfIndex:
    """The index kept at ``path``; its centres and cell sizes, one row per cell each, are read."""
    centers = np.array([r.center for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()])
    cells = spark.read.parquet(f"{path}/cells")
    sizes = np.zeros(len(centers), np.int64)
    for r in cells.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return IvfIndex(path, cells, centers, sizes)


def ivf_append(index: IvfIndex, vectors: DataFrame) -> IvfIndex:
    """Add vectors to the cells they fall in; the centres stay."""
    _place(vectors, index.centers, index.path)
    return ivf_open(vectors.sparkSession, index.path)


def probe_cells(queries: DataFrame, index: IvfIndex, limit: int, nprobe: int) -> tuple[DataFrame, dict[int, int]]:
    """Stored (cell, ls_index, v): each query's nearest cells, ``nprobe`` and more until they hold ``limit`` rows; queries by cell."""
    spark, centers, sizes = queries.sparkSession, index.centers, index.sizes
    shared = spark.sparkContext.broadcast((centers, sizes))

    def probes(batches):
        centers, sizes = shared.value
        for b in batches:
            q = matrix(b.column("vector"))
            size = np.sqrt((q * q).sum(1))
            rows = np.flatnonzero(size > 0)
            if not len(rows):
                continue
            q = q[rows] / size[rows, None]
            order = np.argsort(squared(q, centers), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            at, place = np.nonzero((np.arange(len(centers))[None, :] < nprobe) | (held < limit))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * q.shape[1]), pa.array(q[at].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[at, place].astype(np.int32)), b.column("query").take(pa.array(rows[at])), flat], names=["cell", "ls_index", "v"]
            )

    asked = queries.filter("vector IS NOT NULL").select(F.col("query").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    asked = store(asked.mapInArrow(probes, "cell int, ls_index long, v array<double>"), "ivf-probes")
    return asked, {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}


def ivf_search(queries: DataFrame, index: IvfIndex, limit: int, nprobe: int = 8) -> DataFrame:
    """Approximate search: exact distances, but only in the cells nearest each query.

    At least ``nprobe`` cells are probed, and more until they hold ``limit`` rows. Null and zero queries
    find nothing. Query and cell meet by a join in blocks of bounded size, whatever the number of queries.
    """
    asked, counts = probe_cells(queries, index, limit, nprobe)
    probed = index.cells.filter(F.col("cell").isin(list(counts)))
    right = probed.select("cell", F.array(F.col("ls_index").cast("long")).alias("ids"), l2_normalize("vector").alias("v"))
    return match_blocks(asked, counts, right, dict(enumerate(index.sizes.tolist())), len(index.centers), limit, True).withColumnsRenamed(
        {"ls_index": "query", "neighbor": "ls_index"}
    )


def search_quality(found: DataFrame, expected: DataFrame, labels: DataFrame, topk: int = 5) -> DataFrame:
    """Per query the share of its top-k rows that carry the expected topic.

    ``expected`` is (query, topic), ``labels`` is (ls_index, topic).
    """
    top = found.filter(F.col("rank") <= topk).select("query", "ls_index")
    hit = labels.withColumnRenamed("topic", "got")
    judged = top.join(hit, "ls_index").join(expected, "query")
    ok = F.count_if(F.col("got") == F.col("topic"))
    return judged.groupBy("query").agg(
        ok.alias("hits"), F.count("*").alias("of"), (ok / F.count("*")).alias("share")
    )

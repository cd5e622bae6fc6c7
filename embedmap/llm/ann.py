"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is turned by a fixed random rotation and kept as the signs of its coordinates, with its
length and the inner product of its direction with its own code. From these the inner product with a
query is estimated without bias, and its error is bounded with high probability. Per block the
vectors of best estimate are scored exactly; then every vector whose upper bound still reaches the
worst of the best k so far is scored as well.

Queries and vectors meet in blocks of bounded size: a query block is dealt to ``salts`` places, each
of which sees its share of the vector blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedmap.llm.words import arrow_rows
from embedmap.session import store

QUERY_BLOCK = 2048
BLOCK_BYTES = 8 << 20  # of the vectors in a block
STRIP = 64  # queries estimated at a time
EPSILON = 2.2  # width of the error bound; it fails for about one of a query's near vectors in a hundred
SEED = 20_240_521


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix that depends on the number of dimensions only."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and the inner products of directions with their codes."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]).astype(np.float32) @ turn.T
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, own.astype(np.float64)


_BLOCK = "dims int, size int, ids binary, vectors binary, bits binary, lengths binary, own binary"


def _blocks(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks of (id, vector) that have the same number of dimensions, of bounded bytes or at most ``most`` vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def size_of(dims: int) -> int:
            return most or max(1, BLOCK_BYTES // (8 * dims))

        def block(dims: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([a for a, _ in parts])
            values = np.concatenate([b for _, b in parts])
            turn = rotation(dims)
            limit = size_of(dims)
            for i in range(0, len(ids), limit):
                own = values[i : i + limit]
                packed = (ids[i : i + limit], own, *encode(own, turn))
                yield pa.record_batch(
                    [pa.array([dims], pa.int32()), pa.array([len(own)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                    names=["dims", "size", "ids", "vectors", "bits", "lengths", "own"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                pick = np.flatnonzero(size == dims)
                waiting.setdefault(dims, []).append((ids[pick], flat[at[pick][:, None] + np.arange(dims)]))
                if sum(len(a) for a, _ in waiting[dims]) >= size_of(dims):
                    yield from block(dims, waiting.pop(dims))
        for dims, parts in waiting.items():
            yield from block(dims, parts)

    return arrow_rows(vectors, rows, _BLOCK)


class _Block:
    def __init__(self, row: dict):
        d, n = row["dims"], row["size"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, d)
        bits = np.frombuffer(row["bits"], np.uint8).reshape(n, -1)
        self.signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        self.lengths, self.own = (np.frombuffer(row[k], np.float64) for k in ("lengths", "own"))


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever it is computed."""
    return (vectors * query).sum(axis=1)


def nearest_in_block(block: _Block, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, score) of each query's k nearest of the block found by the codes."""
    n, d = block.vectors.shape
    turned = queries.astype(np.float32) @ rotation(d).T
    scale = (block.lengths / block.own / np.sqrt(d)).astype(np.float32)
    # the error of an estimate for a query of length one, and a little slack for single precision
    spread = block.lengths * (np.sqrt(np.maximum(1 - block.own**2, 0)) / block.own * EPSILON / np.sqrt(max(d - 1, 1)) + 1e-5)
    spread = spread.astype(np.float32)
    norms = np.linalg.norm(queries, axis=1).astype(np.float32)
    first = min(2 * k, n)
    out = []
    for lo in range(0, len(queries), STRIP):
        estimates = (turned[lo : lo + STRIP] @ block.signs.T) * scale
        estimates[query_ids[lo : lo + STRIP, None] == block.ids[None, :]] = -np.inf
        heads = np.argpartition(estimates, n - first, axis=1)[:, n - first :]
        for i, (estimate, head) in enumerate(zip(estimates, heads, strict=True), lo):
            head = head[estimate[head] > -np.inf]
            if not len(head):
                continue
            score = np.sort(_exact(block.vectors[head], queries[i]))
            floor = np.float32(score[-min(k, len(score))])
            near = np.flatnonzero((estimate + spread * norms[i] >= floor) & (estimate > -np.inf))
            near = np.union1d(near, head)
            score = _exact(block.vectors[near], queries[i])
            best = np.lexsort((block.ids[near], -score))[:k]
            out.append((np.full(len(best), i), near[best], score[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) without vectors that are null, zero, or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0)
    return vectors.filter(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row where ``is_query``, over all other rows.

    Nearest is the largest inner product of the original vectors in double precision; ties go to the
    smaller id. Fewer candidates than k are all returned. Rows with a null id, and vectors that are
    null, zero, or hold null or non-finite components, take no part; vectors of different length never
    meet. Repeated query ids count once, repeated candidates stay; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = store(usable(vectors.filter(is_query), id_col, vector_col).dropDuplicates(["id"]), "queries")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = store(_blocks(rows), "vector-blocks")
    salts = max(spark.sparkContext.defaultParallelism, packed.count() // 4)
    queries = _blocks(asked.repartition(groups), QUERY_BLOCK).select("dims", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.monotonically_increasing_id().alias("block"))
    queries = store(queries, "query-blocks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # each vector block goes to one place of every query block
    at = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    numbers = store(queries.select("dims", "block").distinct(), "query-block-numbers")
    dealt = at.join(numbers, "dims")
    both = dealt.join(queries, ["dims", "block", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                ids = np.frombuffer(row["query_ids"], np.int64)
                q, v, s = nearest_in_block(block, ids, np.frombuffer(row["queries"], np.float64).reshape(-1, row["dims"]), k)
                yield pa.record_batch([pa.array(ids[q]), pa.array(block.ids[v]), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = arrow_rows(both.select("dims", "size", "ids", "vectors", "bits", "lengths", "own", "query_ids", "queries"), score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

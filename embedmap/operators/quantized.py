"""Product-quantised search index: short codes of residuals inside coarse cells, then exact reranking (VEC9)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.functions.vectors import l2_normalize
from embedmap.operators.knn import block_parts, matrix, squared
from embedmap.operators.ranking import top_per_group
from embedmap.operators.search import IvfIndex, ivf_append, ivf_build, ivf_open, probe_cells, with_direction
from embedmap.session import scratch_path, store

QUERY_STEP = 128  # queries whose tables of distances are held at once
CODES = 256  # one byte a code


@dataclass
class PqIndex:
    """Coarse cells with whole vectors, their rows' codes in a folder per cell, and the codebooks.

    ``books`` is (subspace, code, dimension of the subspace); the last subspace is padded with zeros.
    """

    ivf: IvfIndex
    codes: DataFrame
    books: np.ndarray


def _pieces(residuals: np.ndarray, m: int) -> np.ndarray:
    """Rows cut into ``m`` subspaces of equal width: (row, subspace, dimension)."""
    width = math.ceil(residuals.shape[1] / m)
    padded = np.zeros((len(residuals), m * width))
    padded[:, : residuals.shape[1]] = residuals
    return padded.reshape(len(residuals), m, width)


def _residuals(u: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest cell of each unit vector, and the vector from its centre."""
    cell = np.concatenate([squared(u[s : s + 1024], centers).argmin(1) for s in range(0, len(u), 1024)] or [np.empty(0, np.int64)])
    return cell, u - centers[cell] if len(u) else u


def _nearest_codes(pieces: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(row, subspace): the nearest entry of each codebook; ties go to the lower code."""
    out = np.empty(pieces.shape[:2], np.uint8)
    for j, book in enumerate(books):
        for s in range(0, len(pieces), 1024):
            out[s : s + 1024, j] = squared(pieces[s : s + 1024, j], book).argmin(1)
    return out


def _codebooks(units: DataFrame, centers: np.ndarray, m: int, rounds: int) -> np.ndarray:
    """Lloyd rounds in all subspaces together: a round is one pass in which tasks sum up their rows per code.

    Starts at the rows of lowest hash. What reaches the driver in a round is one row per code.
    """
    seeds = units.select("u").distinct().orderBy(F.xxhash64("u"), "u").limit(CODES).collect()
    _, first = _residuals(np.array([r.u for r in seeds], dtype=np.float64), centers)
    books = np.ascontiguousarray(_pieces(first, m).transpose(1, 0, 2))
    size, width = books.shape[1:]
    names = [f"s{i}" for i in range(width)]

    def sums(books: np.ndarray) -> DataFrame:
        def run(batches):
            total = np.zeros((m, size, width + 1))
            for b in batches:
                _, res = _residuals(matrix(b.column("u")), centers)
                if len(res):
                    pieces = _pieces(res, m)
                    near = _nearest_codes(pieces, books)
                    for j in range(m):
                        np.add.at(total[j], near[:, j], np.concatenate((np.ones((len(res), 1)), pieces[:, j]), axis=1))
            flat = total.reshape(m * size, width + 1)
            columns = [pa.array(np.arange(m * size)), *[pa.array(flat[:, i]) for i in range(width + 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "n", *names])

        parts = units.select("u").mapInArrow(run, "at long, n double, " + ", ".join(f"{x} double" for x in names))
        return parts.groupBy("at").agg(*[F.sum(x).alias(x) for x in ("n", *names)])

    for _ in range(rounds):
        new = books.copy()
        for r in sums(books).filter("n > 0").collect():
            new[divmod(r["at"], size)] = np.array(r[2:]) / r["n"]
        moved = np.abs(new - books).max()
        books = new
        if moved < 1e-6:
            break
    return books


def _encode(units: DataFrame, centers: np.ndarray, books: np.ndarray, path: str) -> None:
    """Append the codes of unit vectors to the folders of their cells."""

    def run(batches):
        for b in batches:
            cell, res = _residuals(matrix(b.column("u")), centers)
            if len(res):
                code = _nearest_codes(_pieces(res, len(books)), books)
                packed = pa.array([row.tobytes() for row in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("ls_index"), packed, pa.array(cell.astype(np.int32))], names=["ls_index", "code", "cell"])

    coded = units.select("ls_index", "u").mapInArrow(run, "ls_index long, code binary, cell int")
    coded.write.mode("append").partitionBy("cell").parquet(f"{path}/codes")


def _units(vectors: DataFrame) -> DataFrame:
    return with_direction(vectors).select(F.col("ls_index").cast("long").alias("ls_index"), l2_normalize("vector").alias("u"))


def pq_build(
    vectors: DataFrame, nlist: int = 256, subspaces: int = 16, path: str | None = None,
    train_rows: int = 65_536, rounds: int = 12, seed: int = 42,
) -> PqIndex:
    """Index of ``nlist`` coarse cells with a code of ``subspaces`` bytes per row, kept at ``path``.

    Cells are fitted on all vectors, the codebooks on the ``train_rows`` rows of lowest hash; every row
    is indexed. Null and zero vectors are not, as in ``ivf_build``.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "pq")
    ivf = ivf_build(vectors, nlist, path, seed)
    units = store(_units(vectors), "pq-units")
    drawn = store(units.orderBy(F.xxhash64("ls_index", F.lit(seed)), "ls_index").limit(train_rows), "pq-training")
    books = _codebooks(drawn, ivf.centers, subspaces, rounds)
    rows = [(j, c, book[c].tolist()) for j, book in enumerate(books) for c in range(len(book))]
    spark.createDataFrame(rows, "subspace int, code int, entry array<double>").coalesce(1).write.parquet(f"{path}/books")
    _encode(units, ivf.centers, books, path)
    return pq_open(spark, path)


def pq_open(spark: SparkSession, path: str) -> PqIndex:
    """The index kept at ``path``; its codebooks, at most 256 entries per subspace, are read."""
    rows = spark.read.parquet(f"{path}/books").orderBy("subspace", "code").collect()
    entries = np.array([r.entry for r in rows])
    books = entries.reshape(rows[-1].subspace + 1, rows[-1].code + 1, -1)
    return PqIndex(ivf_open(spark, path), spark.read.parquet(f"{path}/codes"), books)


def pq_append(index: PqIndex, vectors: DataFrame) -> PqIndex:
    """Add vectors under the centres and codebooks there are."""
    ivf = ivf_append(index.ivf, vectors)
    _encode(_units(vectors), ivf.centers, index.books, ivf.path)
    return pq_open(vectors.sparkSession, ivf.path)


def _table_distances(q: np.ndarray, center: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(query, row): squared distance from query to coded row, summed up from a table per subspace."""
    pieces = _pieces(q - center, len(books))
    out = np.zeros((len(q), len(codes)))
    for j, book in enumerate(books):
        out += squared(pieces[:, j], book)[:, codes[:, j]]
    return out


def _shortlist(pairs: DataFrame, centers: np.ndarray, books: np.ndarray, keep: int) -> DataFrame:
    """(query, cell, ls_index, estimate): of each pair of blocks the ``keep`` rows of least estimate per query."""
    shared = pairs.sparkSession.sparkContext.broadcast((centers, books))

    def run(batches):
        centers, books = shared.value
        for b in batches:
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                left, right = b.column("left")[i].values, b.column("right")[i].values
                asked = left.field("ls_index").to_numpy(zero_copy_only=False)
                q = matrix(left.field("v"))
                ids = right.field("ls_index").to_numpy(zero_copy_only=False)
                codes = np.array([np.frombuffer(x, np.uint8) for x in right.field("code").to_pylist()])
                order = np.argsort(ids, kind="stable")
                ids, codes = ids[order], codes[order]
                for s in range(0, len(q), QUERY_STEP):
                    d = _table_distances(q[s : s + QUERY_STEP], centers[cells[i]], codes, books)
                    best = np.argsort(d, axis=1, kind="stable")[:, :keep]
                    n = best.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asked[s : s + QUERY_STEP], best.shape[1])), pa.array(np.full(n, cells[i], np.int32)),
                         pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())],
                        names=["query", "cell", "ls_index", "estimate"],
                    )

    return pairs.mapInArrow(run, "query long, cell int, ls_index long, estimate double")


def pq_search(queries: DataFrame, index: PqIndex, limit: int, nprobe: int = 8, rerank: int = 10) -> DataFrame:
    """(query, ls_index, distance, rank): codes of the probed cells choose ``rerank * limit`` rows, exact distances order them.

    At least ``nprobe`` cells are probed, and more until they hold that shortlist. Only the codes are read
    for the choice; blocks of queries meet blocks of codes by (cell, block), so a hot cell is spread over
    tasks. Whole vectors are read for the shortlist. Null and zero queries find nothing; ties go to the lower id.
    """
    keep, sizes = rerank * limit, index.ivf.sizes
    asked, counts = probe_cells(queries, index.ivf, keep, nprobe)
    right_counts = dict(enumerate(sizes.tolist()))
    home = F.pmod(F.xxhash64("ls_index"), block_parts(counts, len(sizes))).alias("home")
    left = asked.groupBy("cell", home).agg(F.collect_list(F.struct("ls_index", "v")).alias("left"))
    parts = block_parts(right_counts, len(sizes))
    left = left.select("cell", "left", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    part = F.pmod(F.xxhash64("ls_index"), parts).alias("part")
    coded = index.codes.filter(F.col("cell").isin(list(counts)))
    right = coded.groupBy("cell", part).agg(F.collect_list(F.struct("ls_index", "code")).alias("right"))
    pairs = left.join(right, ["cell", "part"]).select("cell", "left", "right")
    found = _shortlist(pairs, index.ivf.centers, index.books, keep)
    chosen = store(top_per_group(found, ["query"], ["estimate", "ls_index"], keep).select("query", "cell", "ls_index"), "pq-shortlist")
    good = F.col("vector").isNotNull()
    asks = queries.filter(good).select(F.col("query").cast("long").alias("query"), l2_normalize("vector").alias("q"))
    whole = index.ivf.cells.filter(F.col("cell").isin(list(counts))).select("cell", "ls_index", l2_normalize("vector").alias("v"))
    met = chosen.join(whole, ["cell", "ls_index"]).join(asks, "query")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    exact = met.select("query", "ls_index", (1.0 - product).alias("distance"))
    return top_per_group(exact, ["query"], ["distance", "ls_index"], limit)

"""Exact k-nearest-neighbour join (VEC4), without comparing all pairs of rows.

1. Equal vectors of the searched side are folded into one representative that keeps its lowest
   ids, so copies never multiply the work.
2. A bounded set of pivots, drawn by hash from the distinct vectors, splits that side into cells;
   dense regions get more pivots.
3. Every row of the other side gets an upper bound of its k-th distance from the cells' nearest
   distances, and is sent only to cells that can hold something closer (triangle inequality and
   bisector bound). The result is exact: bounds only remove cells that cannot matter.
4. Both sides meet on the cell in blocks of bounded size (a big cell has several blocks), distances
   are one matrix product per pair of blocks, and only the best k per block travel on.

In few dimensions (maps) a row visits a handful of cells. In many dimensions bounds remove little
and the work tends to all pairs: there are no cells, both sides are cut into few large blocks by hash and every two
blocks meet in a task, so a row is sent a fixed number of times until blocks reach ``BLOCK_BYTES``.
``ivf_search`` is the approximate way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.functions.vectors import as_doubles, l2_normalize
from embedmap.operators.ranking import top_per_group
from embedmap.session import cut_lineage, store

BLOCK_ROWS = 2048
TOL = 1e-9
NEAR_CELLS = 8  # cells looked at for the upper bound of the k-th distance
WIDE = 16  # above this many dimensions bounds hardly prune
WIDE_PARTS = 8  # blocks of a side in many dimensions, more only where they would pass BLOCK_BYTES
BLOCK_BYTES = 2**26
FOUND = "ls_index long, neighbor long, distance double"


def matrix(column: pa.Array) -> np.ndarray:
    """List column as a 2-D array, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    if a.shape[1] <= 4:
        return sum((a[:, [j]] - b[:, j][None, :]) ** 2 for j in range(a.shape[1]))
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _pick_pivots(points: DataFrame, rows: int) -> np.ndarray:
    """The square root of the rows, as distinct vectors chosen by hash among a thinned set."""
    count = max(1, math.isqrt(rows))
    h = F.xxhash64("v")
    steps = 1_000_000
    share = min(steps, math.ceil(steps * 8 * count / rows))
    thin = points.filter(F.pmod(h, F.lit(steps)) < share).select("v").distinct()
    got = thin.orderBy(F.xxhash64("v", F.lit(1))).limit(count).collect()
    got = got or points.select("v").limit(1).collect()
    return np.array([r["v"] for r in got], dtype=np.float64)


def _assign(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of every representative and the distance to it."""

    def run(batches):
        for b in batches:
            v = matrix(b.column("v"))
            cell = np.empty(len(v), np.int32)
            dist = np.empty(len(v))
            for s in range(0, len(v), 1024):
                d = squared(v[s : s + 1024], pivots)
                cell[s : s + 1024] = d.argmin(1)
                diff = v[s : s + 1024] - pivots[cell[s : s + 1024]]
                dist[s : s + 1024] = np.sqrt((diff * diff).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("ids"), b.column("v"), pa.array(cell), pa.array(dist)],
                names=["ids", "v", "cell", "dist"],
            )

    return reps.mapInArrow(run, "ids array<long>, v array<double>, cell int, dist double")


def _visits(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, nearest: np.ndarray, k: int) -> DataFrame:
    """One row per (left row, cell it must visit)."""
    near = min(NEAR_CELLS, len(pivots))
    step = max(1, 4_000_000 // len(pivots))

    def run(batches):
        for b in batches:
            v_all = matrix(b.column("v"))
            for s in range(0, len(v_all), step):
                v = v_all[s : s + step]
                d = np.sqrt(squared(v, pivots))
                close = np.argpartition(d, near - 1, axis=1)[:, :near]
                reach = np.take_along_axis(d, close, 1)[:, :, None] + nearest[close]
                reach = reach.reshape(len(v), -1)
                bound = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(v), np.inf)
                home = d.argmin(1)
                own = d[np.arange(len(v)), home]
                side = (d * d - (own * own)[:, None]) / np.maximum(2 * np.sqrt(squared(pivots[home], pivots)), 1e-300)
                slack = (bound + 1e-7 * (1 + own))[:, None]
                visit = (d - radius[None, :] <= slack) & (side <= slack)
                at, cell = np.nonzero(visit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int32)),
                        b.column("ls_index").slice(s, len(v)).take(pa.array(at)),
                        b.column("v").slice(s, len(v)).take(pa.array(at)),
                    ],
                    names=["cell", "ls_index", "v"],
                )

    return rows.mapInArrow(run, "cell int, ls_index long, v array<double>")


def block_parts(counts: dict[int, int], cells: int) -> Column:
    """Number of blocks of the row's cell."""
    parts = [max(1, math.ceil(counts.get(c, 0) / BLOCK_ROWS)) for c in range(cells)]
    return F.element_at(F.lit(np.array(parts, dtype=np.int64)), F.col("cell") + 1)


def match_blocks(
    left: DataFrame, left_counts: dict[int, int], right: DataFrame, right_counts: dict[int, int], cells: int, k: int, cosine: bool
) -> DataFrame:
    """(ls_index, neighbor, distance, rank) over the pairs that share a cell.

    ``left`` is (cell, ls_index, v), ``right`` (cell, ids, v). Rows are packed into blocks of about
    BLOCK_ROWS; a left block is sent to each right block of its cell, so work spreads by (cell, right
    block) and not by cell alone.
    """
    home = F.pmod(F.xxhash64("ls_index"), block_parts(left_counts, cells)).alias("home")
    lblocks = left.groupBy("cell", home).agg(F.collect_list(F.struct("ls_index", "v")).alias("left"))
    last = (block_parts(right_counts, cells) - 1).cast("long")
    lblocks = lblocks.select("cell", "left", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    part = F.pmod(F.xxhash64("ids"), block_parts(right_counts, cells)).alias("part")
    rblocks = right.groupBy("cell", part).agg(F.collect_list(F.struct("ids", "v")).alias("right"))
    found = _match(lblocks.join(rblocks, ["cell", "part"]).select("left", "right"), k, cosine)
    return top_per_group(found, ["ls_index"], ["distance", "neighbor"], k)


def best_pairs(lv: np.ndarray, rv: np.ndarray, k: int, cosine: bool, ids: np.ndarray):
    """Row, column and distance of the k nearest right rows per left row; ties go to the lower id.

    Products pick what may be among the k, ties included; the final distance and the id decide, so
    exactly k (or all) columns of a row are given however many are equal.
    """
    step = max(1, 4_000_000 // max(1, len(rv)))
    for s in range(0, len(lv), step):
        a = lv[s : s + step]
        d = squared(a, rv)
        if len(rv) > k:
            kth = np.partition(d, k - 1, axis=1)[:, [k - 1]]
            row, col = np.nonzero(d <= kth + TOL)
        else:
            row, col = np.nonzero(np.ones_like(d, dtype=bool))
        if cosine:
            dist = 1.0 - (a[row] * rv[col]).sum(1)
        else:
            diff = a[row] - rv[col]
            dist = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[best] + s, col[best], dist[best]


def _named(found, lid: np.ndarray, first: np.ndarray, flat: np.ndarray, k: int):
    """(ls_index, neighbor, distance) of found (row, column, distance), the k nearest of all copies for each row."""
    for row, col, dist in found:
        n = first[col + 1] - first[col]
        start = np.repeat(first[col], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, neighbor, dist = np.repeat(row, n), flat[(start + within).astype(np.int64)], np.repeat(dist, n)
        order = np.lexsort((neighbor, dist, row))
        row, neighbor, dist = row[order], neighbor[order], dist[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(lid[row[best]]), pa.array(neighbor[best]), pa.array(dist[best])], names=["ls_index", "neighbor", "distance"])


def _copies(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each representative's ids begin, and all ids."""
    first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
    return first, ids.flatten().to_numpy(zero_copy_only=False)


def _match(pairs: DataFrame, k: int, cosine: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                left = b.column("left")[i].values
                right = b.column("right")[i].values
                first, flat = _copies(right.field("ids"))
                found = best_pairs(matrix(left.field("v")), matrix(right.field("v")), k, cosine, flat[first[:-1]])
                yield from _named(found, left.field("ls_index").to_numpy(zero_copy_only=False), first, flat, k)

    return pairs.mapInArrow(run, FOUND)


def _near_products(a: np.ndarray, rv: np.ndarray, half: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what may be among the k nearest, ties included, of a few rows among many.

    The right side is read in pieces that fit the cache; the k-th found so far, less twice the error of a product, is the bound for the next piece.
    """
    rows, cols, values = [], [], []
    bound, held = np.full((len(a), 1), -np.inf, a.dtype), 0
    for s in range(0, len(rv), BLOCK_ROWS):
        near = a @ rv[s : s + BLOCK_ROWS].T
        near -= half[s : s + BLOCK_ROWS]
        if near.shape[1] > k and s == 0:
            bound = np.partition(near, -k, axis=1)[:, [-k]] - slack
        row, col = np.divmod(np.flatnonzero(near >= bound), near.shape[1])
        rows.append(row)
        cols.append(col + s)
        values.append(near[row, col])
        held += len(row)
        if held > 4 * k * len(a) or s + BLOCK_ROWS >= len(rv):
            row, col, value = (np.concatenate(x) for x in (rows, cols, values))
            order = np.lexsort((-value, row))
            row, col, value = row[order], col[order], value[order]
            last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            bound[row[last], 0] = value[last] - slack[row[last], 0]
            keep = value >= bound[row, 0]
            rows, cols, values, held = [row[keep]], [col[keep]], [value[keep]], int(keep.sum())
    return rows[0], cols[0]


def _wide_pairs(lv: np.ndarray, rv: np.ndarray, k: int, cosine: bool, ids: np.ndarray):
    """What ``best_pairs`` gives, for large sides in many dimensions.

    Products in single precision choose what may be among the k, with a bound on their error; distances are in double.
    """
    size = np.sqrt((rv * rv).sum(1))
    own, most = np.sqrt((lv * lv).sum(1))[:, None], size.max()
    # single precision neither overflows nor loses its lowest bits here
    single = 1e-12 < most < 1e12 and own.max() < 1e12
    kind = np.float32 if single else np.float64
    slack = TOL + (4.0 * (lv.shape[1] + 4) * float(np.finfo(kind).eps) * most * (own + most))
    near, half = rv.astype(kind, copy=False), (0.5 * size * size).astype(kind)
    for s in range(0, len(lv), 512):
        a = lv[s : s + 512]
        row, col = _near_products(a.astype(kind, copy=False), near, half, slack[s : s + 512].astype(kind), k)
        if cosine:
            dist = 1.0 - (a[row] * rv[col]).sum(1)
        else:
            diff = a[row] - rv[col]
            dist = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[best] + s, col[best], dist[best]


def _wide_parts(rows: int, dims: int) -> int:
    return max(1, min(WIDE_PARTS, rows // BLOCK_ROWS), math.ceil(rows * dims * 8 / BLOCK_BYTES))


def _dealt(left: DataFrame, left_parts: int, right: DataFrame, right_parts: int) -> DataFrame:
    """(pair, ids, v, asks): every two blocks of (ls_index, v) and (ids, v), ``asks`` for the left one.

    A pair of blocks is a partition by its number, so no task gets two pairs while others get none, and no rows are sorted.
    """
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    lside = left.select(part("ls_index", left_parts).alias("l"), every(right_parts).alias("r"), F.array("ls_index").alias("ids"), "v", F.lit(True).alias("asks"))
    rside = right.select(every(left_parts).alias("l"), part("ids", right_parts).alias("r"), "ids", "v", F.lit(False).alias("asks"))
    pair = (F.col("l") * right_parts + F.col("r")).cast("int").alias("pair")
    return lside.unionByName(rside).select(pair, "ids", "v", "asks").repartitionById(left_parts * right_parts, F.col("pair"))


def match_wide(left: DataFrame, left_parts: int, right: DataFrame, right_parts: int, k: int, cosine: bool) -> DataFrame:
    """(ls_index, neighbor, distance, rank) over all pairs of (ls_index, v) and (ids, v), every two blocks in a task."""

    def run(batches):
        sides = {True: [], False: []}
        for b in batches:
            for asks, rows in sides.items():
                own = b.select(["ids", "v"]).filter(b.column("asks") if asks else pc.invert(b.column("asks")))
                if own.num_rows:
                    rows.append(own)
        if not sides[True] or not sides[False]:
            return
        lt, rt = (pa.Table.from_batches(sides.pop(asks)) for asks in (True, False))
        lid, (first, flat) = _copies(lt.column("ids").combine_chunks())[1], _copies(rt.column("ids").combine_chunks())
        lv, rv = matrix(lt.column("v")), matrix(rt.column("v"))
        del lt, rt
        yield from _named(_wide_pairs(lv, rv, k, cosine, flat[first[:-1]]), lid, first, flat, k)

    return top_per_group(_dealt(left, left_parts, right, right_parts).mapInArrow(run, FOUND), ["ls_index"], ["distance", "neighbor"], k)


@dataclass
class Prepared:
    """The searched side of a kNN join: stored representatives in cells, and what bounds the search.

    In many dimensions there are no pivots, and the one cell 0 counts all representatives.
    """

    placed: DataFrame
    pivots: np.ndarray | None
    radius: np.ndarray
    nearest: np.ndarray
    counts: dict[int, int]
    want: int
    metric: str
    dims: int


def _clean(df: DataFrame, vector: str, metric: str) -> DataFrame:
    prep = l2_normalize(vector) if metric == "cosine" else as_doubles(vector)
    rows = df.select(F.col("ls_index").cast("long"), prep.alias("v"))
    return rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def prepare(right: DataFrame, want: int, metric: str = "euclidean", vector: str = "vector") -> Prepared | None:
    """Cells of the searched side for joins of up to ``want`` neighbours; None if it is empty."""
    rrows = _clean(right, vector, metric)
    size = rrows.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dims")).first()
    rows = size["rows"]
    if rows == 0:
        return None
    copies = top_per_group(rrows, ["v"], ["ls_index"], want)
    reps = copies.groupBy("v").agg(F.array_sort(F.collect_list("ls_index")).alias("ids"))
    if size["dims"] > WIDE:
        placed = store(reps.select("ids", "v"), "searched-rows")
        return Prepared(placed, None, np.empty(0), np.empty((0, want)), {0: placed.count()}, want, metric, size["dims"])

    pivots = _pick_pivots(rrows, rows)
    cells = len(pivots)
    placed = cut_lineage(_assign(reps.select("ids", "v"), pivots))

    # both results are bounded by the number of pivots
    radius, counts = np.full(cells, -np.inf), {}
    for r in placed.groupBy("cell").agg(F.max("dist").alias("u"), F.count("*").alias("n")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["u"], r["n"]
    nearest = np.full((cells, want), np.inf)
    for r in top_per_group(placed.select("cell", "dist"), ["cell"], ["dist"], want).collect():
        nearest[r["cell"], r["rank"] - 1] = r["dist"]

    return Prepared(placed, pivots, radius, nearest, counts, want, metric, size["dims"])


def knn_join(
    left: DataFrame,
    right: DataFrame | Prepared,
    k: int,
    metric: str = "euclidean",
    include_self: bool = True,
    vector: str = "vector",
) -> DataFrame:
    """(ls_index, neighbor, distance, rank): the k nearest right rows of every left row.

    Ties go to the lower neighbour id. With the cosine metric, zero vectors have no neighbours.
    ``right`` may be prepared once for many joins.
    """
    lrows = _clean(left, vector, metric)
    want = k if include_self else k + 1
    to = prepare(right, want, metric, vector) if isinstance(right, DataFrame) else right
    if to is None:
        empty = lrows.select("ls_index", F.col("ls_index").alias("neighbor"), F.lit(0.0).alias("distance"))
        return empty.withColumn("rank", F.lit(1)).limit(0)
    if to.want < want or to.metric != metric:
        raise ValueError("prepared for fewer neighbours or another metric")
    if to.pivots is None:
        found = match_wide(lrows, _wide_parts(lrows.count(), to.dims), to.placed, _wide_parts(to.counts[0], to.dims), want, metric == "cosine")
    else:
        visits = cut_lineage(_visits(lrows, to.pivots, to.radius, to.nearest[:, :want], want))
        lcounts = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        found = match_blocks(visits, lcounts, to.placed.select("cell", "ids", "v"), to.counts, len(to.pivots), want, metric == "cosine")
    if include_self:
        return found
    return top_per_group(found.filter(F.col("ls_index") != F.col("neighbor")).drop("rank"), ["ls_index"], ["distance", "neighbor"], k)

"""Neighbour graph by descent (VEC4 in many dimensions): neighbours of neighbours are likely neighbours.

Rows are first dealt into blocks of bounded size by the signs of random projections, a few times over,
and meet within their blocks. Then rounds improve the lists: each row brings its neighbours and a bounded
number of the rows that list it together, and whoever gets nearer to someone than the last of that one's
list is told. Rounds end when they change few entries (doi:10.1145/1963405.1963487). Work per
round is rows times a bounded number of pairs, where the exact join tends to all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from embedmap.functions.vectors import as_doubles, norm
from embedmap.operators.knn import _clean, matrix, squared
from embedmap.operators.ranking import top_per_group
from embedmap.session import store

BLOCK = 128  # rows that meet at once in a start table
CENTERS = 256  # groups of a round whose pairs leave a task together
FOUND = "ls_index long, neighbor long, distance double"


def _distances(v: np.ndarray, cosine: bool) -> np.ndarray:
    """All distances within a block; nothing is its own neighbour."""
    d = np.maximum(1.0 - v @ v.T, 0.0) if cosine else np.sqrt(squared(v, v))
    np.fill_diagonal(d, np.inf)
    return d


def _compact(vectors: DataFrame, reps: DataFrame, vector: str, cosine: bool) -> DataFrame:
    """(ls_index, v, s) of the representatives, whose vectors are v / s; v is in single precision where that loses nothing.

    Rows travel many times a round, and given vectors often are in single precision while normalized ones never are.
    """
    x = as_doubles(vector)
    raw = vectors.select(F.col("ls_index").cast("long"), x.alias("v"), (norm(x) if cosine else F.lit(1.0)).alias("s"))
    raw = store(raw.join(reps.select("ls_index"), "ls_index", "left_semi"), "compact-rows")
    exact = raw.agg(F.bool_and(F.forall("v", lambda c: c.cast("float").cast("double") == c))).first()[0]
    return raw.withColumn("v", F.col("v").cast("array<float>")) if exact else raw


def _whole(v: pa.Array, s: np.ndarray) -> np.ndarray:
    return matrix(v) / s[:, None]


def _coded(rows: DataFrame, tables: int, bits: int, dims: int, seed: int) -> DataFrame:
    """(ls_index, v, s, t, code): the signs of a table's random projections."""
    planes = np.random.default_rng(seed).normal(size=(dims, tables * bits))
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            signs = (_whole(b.column("v"), b.column("s").to_numpy()) @ planes > 0).reshape(b.num_rows, tables, bits)
            codes = (signs * place).sum(2).astype(np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [b.column("ls_index"), b.column("v"), b.column("s"), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(codes[:, t])],
                    names=["ls_index", "v", "s", "t", "code"],
                )

    return rows.mapInArrow(run, f"ls_index long, v {rows.schema['v'].dataType.simpleString()}, s double, t int, code long")


def _met(blocks: DataFrame, k: int, cosine: bool) -> DataFrame:
    """Every row's k nearest within its block of (ids, vs, ss)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values.to_numpy(zero_copy_only=False)
                d = _distances(_whole(b.column("vs")[i].values, b.column("ss")[i].values.to_numpy(zero_copy_only=False)), cosine)
                col = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, : min(k, len(ids) - 1)]
                row = np.repeat(np.arange(len(ids)), col.shape[1])
                col = col.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[col]), pa.array(d[row, col])], names=["ls_index", "neighbor", "distance"])

    return blocks.mapInArrow(run, FOUND)


def _start(rows: DataFrame, n: int, dims: int, k: int, cosine: bool, tables: int, seed: int) -> DataFrame:
    bits = max(0, int(np.log2(max(n / BLOCK, 1))))
    coded = store(_coded(rows, tables, bits, dims, seed), "codes")
    sizes = coded.groupBy("t", "code").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = coded.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("ls_index", "t"), parts))
    members = F.collect_list(F.struct("ls_index", "v", "s")).alias("m")
    blocks = dealt.groupBy("t", "code", "part").agg(members).select(F.col("m.ls_index").alias("ids"), F.col("m.v").alias("vs"), F.col("m.s").alias("ss"))
    return _met(blocks, k, cosine)


def _lists(found: DataFrame, k: int) -> DataFrame:
    # an entry of the list that is met again is not new
    once = found.groupBy("ls_index", "neighbor").agg(F.min("distance").alias("distance"), F.max("old").alias("old"))
    return top_per_group(once, ["ls_index"], ["distance", "neighbor"], k)


def _nearer(b: pa.RecordBatch, cosine: bool) -> pa.RecordBatch:
    """Pairs of one row of (ids, vs, ss, ends, old) that are nearer than the first one's end; arrays hold many rows, distances one."""
    ids, sizes, ends, old = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ss", "ends", "old"))
    v = _whole(b.column("vs").flatten(), sizes)
    edges = np.cumsum([0, *b.column("ids").value_lengths().to_pylist()])
    rows, cols, far = [], [], []
    for s, e in zip(edges, edges[1:]):
        d = _distances(v[s:e], cosine)
        new = old[s:e] == 0
        # pairs of two entries that were there in an earlier round have met already
        row, col = np.nonzero((d < ends[s:e, None]) & (new[:, None] | new[None, :]))
        rows.append(row + s)
        cols.append(col + s)
        far.append(d[row, col])
    row, col, distance = (np.concatenate(x) for x in (rows, cols, far))
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[col]), pa.array(distance)], names=["ls_index", "neighbor", "distance"])


def _improved(lists: DataFrame, rows: DataFrame, k: int, cosine: bool, turn: int) -> DataFrame:
    """(ls_index, neighbor, distance) nearer than the end of the list, among the neighbours of one row.

    A row brings together at most k of its list and k of those that list it, the latter by hash.
    """
    back = lists.select(F.col("neighbor").alias("ls_index"), F.col("ls_index").alias("neighbor"), "old")
    back = top_per_group(back.withColumn("h", F.xxhash64("ls_index", "neighbor", F.lit(turn))), ["ls_index"], ["old", "h"], k)
    around = lists.select("ls_index", "neighbor", "old").union(back.select("ls_index", "neighbor", "old"))
    # a center that lists no new entry, and is in no new one, has nothing to tell: its vectors stay where they are
    around = around.select(F.col("ls_index").alias("center"), "neighbor", "old").repartition("center").groupBy("center", "neighbor").agg(F.min("old").alias("old"))
    around = around.withColumn("all_old", F.min("old").over(W.partitionBy("center"))).filter("all_old = 0").drop("all_old")
    ends = lists.groupBy("ls_index").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("end"))
    known = rows.join(ends, "ls_index").select(F.col("ls_index").alias("neighbor"), "v", "s", "end")
    members = F.collect_list(F.struct("neighbor", "v", "s", "end", "old")).alias("m")
    # at most 2k rows a center
    groups = around.join(known, "neighbor").groupBy("center").agg(members)
    groups = groups.select(F.col("m.neighbor").alias("ids"), F.col("m.v").alias("vs"), F.col("m.s").alias("ss"), F.col("m.end").alias("ends"), F.col("m.old").alias("old"))

    def run(batches):
        for b in (whole.slice(s, CENTERS) for whole in batches for s in range(0, whole.num_rows, CENTERS)):
            found = _nearer(b, cosine)
            if found.num_rows:
                yield found

    return groups.mapInArrow(run, FOUND)


def neighbor_descent(
    vectors: DataFrame, k: int = 15, metric: str = "cosine", rounds: int = 12, until: float = 0.001, tables: int = 4, seed: int = 42, vector: str = "vector"
) -> DataFrame:
    """(ls_index, neighbor, distance, rank): about the k nearest other rows of every row.

    Rounds end when at most the share ``until`` of all entries changed, or after ``rounds``. Equal vectors (for
    the cosine metric, of equal direction) are one during the search, and give their lowest
    ids, so copies do not fill the lists. Null vectors, and zero ones for the cosine metric, have no
    neighbours and are none. Ties go to the lower id. ``knn_join`` is exact.
    """
    cosine = metric == "cosine"
    clean = store(_clean(vectors, vector, metric), "descent-rows")
    size = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not size.n:
        return clean.select("ls_index", F.col("ls_index").alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    copies = store(top_per_group(clean, ["v"], ["ls_index"], k + 1).drop("rank"), "copies")
    reps = store(copies.groupBy("v").agg(F.min("ls_index").alias("ls_index")).select("ls_index", "v"), "distinct-rows")
    n = reps.count()
    rows = _compact(vectors, reps, vector, cosine)
    first = _start(rows, n, size.dims, k, cosine, tables, seed).withColumn("old", F.lit(0))
    lists = store(_lists(first, k), "neighbor-lists")
    for turn in range(rounds):
        better = _improved(lists, rows, k, cosine, turn).withColumn("old", F.lit(0))
        before = lists.select("ls_index", "neighbor", "distance", F.lit(1).alias("old"))
        lists = store(_lists(before.unionByName(better), k), "neighbor-lists")
        if lists.filter("old = 0").count() <= until * n * k:
            break
    named = copies.join(reps.withColumnRenamed("ls_index", "rep"), "v").select(F.col("ls_index").alias("member"), "rep")
    named = store(named, "named-copies")
    whole = clean.join(reps.withColumnRenamed("ls_index", "rep"), "v").select("ls_index", "rep")
    # a row's own copies are nearest; at most k + 1 members stand for a vector
    own = named.select("rep", F.col("rep").alias("of"), F.col("member").alias("neighbor"), F.lit(0.0).alias("distance"))
    other = lists.select(F.col("ls_index").alias("rep"), F.col("neighbor").alias("of"), "distance").join(named.withColumnsRenamed({"rep": "of", "member": "neighbor"}), "of")
    near = own.unionByName(other.select(own.columns))
    # k + 1 for each vector first, as one of them may be the row itself
    near = top_per_group(near, ["rep"], ["distance", "neighbor"], k + 1).select("rep", "neighbor", "distance")
    found = whole.join(near, "rep").filter(F.col("ls_index") != F.col("neighbor")).select("ls_index", "neighbor", "distance")
    return top_per_group(found, ["ls_index"], ["distance", "neighbor"], k)

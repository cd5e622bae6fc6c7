"""Maps of sparse features by a randomised singular value decomposition (PRJ3).

The matrix stays a table of its entries. A round multiplies it and its transpose with a thin block: two joins and
two sums, with nothing as wide as the rows. Only square matrices of the basis's width reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.knn import matrix
from embedmap.operators.project import AXES, normalize_frame
from embedmap.session import store


def unit_entries(features: DataFrame, num_features: int) -> DataFrame:
    """(ls_index, feature_id, act): positive activations, each feature scaled to unit length over the rows."""
    pairs = features.select("ls_index", F.explode(F.arrays_zip("top_indices", "top_acts")).alias("f"))
    acts = pairs.select("ls_index", F.col("f.top_indices").cast("long").alias("feature_id"), F.col("f.top_acts").cast("double").alias("act"))
    acts = acts.filter((F.col("act") > 0) & (F.col("feature_id") < num_features))
    norms = store(acts.groupBy("feature_id").agg(F.sqrt(F.sum(F.col("act") ** 2)).alias("norm")), "norms")
    return store(acts.join(norms, "feature_id").select("ls_index", "feature_id", (F.col("act") / F.col("norm")).alias("act")), "entries")


def _gram(block: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns of a block: one matrix per batch of rows, summed by place."""

    def run(batches):
        for b in batches:
            m = matrix(b.column("q"))
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array([(m.T @ m).ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = block.select("q").mapInArrow(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("g"))
    out = np.zeros(width * width)
    for r in parts.collect():  # width * width numbers
        out[r["pos"]] = r["g"]
    return out.reshape(width, width)


def _times(entries: DataFrame, block: DataFrame, by: str, onto: str, width: int) -> DataFrame:
    """The matrix or its transpose times a block: (onto, q)."""
    sums = entries.join(block, by).groupBy(onto).agg(*[F.sum(F.col("act") * F.col("q")[j]).alias(f"q{j}") for j in range(width)])
    return store(sums.select(onto, F.array(*[f"q{j}" for j in range(width)]).alias("q")), "block")


def _turn(block: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """Each row of a block times a small matrix."""

    def run(batches):
        for b in batches:
            q = matrix(b.column("q"))
            out = (q @ m).ravel() if len(q) else np.zeros(0)
            rows = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * m.shape[1], pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(key), rows], names=[key, "q"])

    return block.select(F.col(key).cast("long"), "q").mapInArrow(run, f"{key} long, q array<double>")


def _orthonormal(gram: np.ndarray, least: float) -> np.ndarray:
    """Matrix that makes a block's columns orthonormal; directions of less weight than ``least`` become zero."""
    values, turned = np.linalg.eigh(gram)
    keep = values > least
    return turned * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _ritz(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues within the span of a basis, largest first, and their vectors in terms of it.

    ``gram`` holds the products of the basis and its image, side by side.
    """
    m = len(gram) // 2
    ortho = _orthonormal(gram[:m, :m], max(gram[:m, :m].trace(), 0.0) * 1e-12)
    inner = ortho.T @ gram[:m, m:] @ ortho
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    return np.maximum(values[::-1][:width], 0.0), (ortho @ turned)[:, ::-1][:, :width]


def sparse_svd(entries: DataFrame, k: int, oversample: int = 14, rounds: int | None = None, tolerance: float = 1e-5, blocks: int = 6) -> tuple[DataFrame, list[float]]:
    """(feature_id, q) with the ``k`` leading left singular vectors in ``q``, and their singular values, largest first.

    ``entries`` are (ls_index, feature_id, act). A basis of vectors, at first ``k + oversample`` hashed ones, grows each
    round by what its best vectors lack to be singular vectors; at ``blocks`` times that width it is cut down to the
    best. It ends when each leading vector, times the matrix and its transpose, differs from its multiple by less than
    ``tolerance`` of that (or 1e-7 of the largest), or earlier after ``rounds``, if the caller sets them. Of an empty table there are no rows and all values are zero.
    """
    width = k + oversample
    start = lambda j: F.pmod(F.xxhash64("feature_id", F.lit(j)), F.lit(2**20)) / 2.0**19 - 1
    ids = entries.select("feature_id").distinct()
    fresh = store(ids.select("feature_id", F.array(*[start(j) for j in range(width)]).alias("q")), "block")
    # the basis and its image under the matrix and its transpose: nothing of it is as long as the rows
    space, have, done = None, 0, 0
    while True:
        image = _times(entries, _times(entries, fresh, "feature_id", "ls_index", width), "ls_index", "feature_id", width)
        both = fresh.select("feature_id", F.col("q").alias("s")).join(image.withColumnRenamed("q", "w"), "feature_id")
        if space is not None:
            both = both.withColumnsRenamed({"s": "s1", "w": "w1"}).join(space, "feature_id")
            both = both.select("feature_id", F.concat("s", "s1").alias("s"), F.concat("w", "w1").alias("w"))
        space, have = store(both, "space"), have + width
        sides = space.select("feature_id", F.concat("s", "w").alias("q"))
        gram = _gram(sides, 2 * have)
        values, best = _ritz(gram, width)
        lack = np.vstack([-best * values, best])
        gaps = lack.T @ gram @ lack
        most = values.max(initial=0.0)
        if np.all(np.sqrt(np.maximum(np.diag(gaps)[:k], 0.0)) <= np.maximum(tolerance * values[:k], 1e-7 * most)):
            break
        done += 1
        if done == rounds:
            break
        fresh = store(_turn(sides, "feature_id", lack @ _orthonormal(gaps, (1e-7 * most) ** 2)), "block")
        if have >= blocks * width:
            zero = np.zeros_like(best)
            kept = _turn(sides, "feature_id", np.block([[best, zero], [zero, best]]))
            space, have = store(kept.select("feature_id", F.slice("q", 1, width).alias("s"), F.slice("q", width + 1, width).alias("w")), "space"), width
    vectors = space.select("feature_id", F.col("s").alias("q"))
    return _turn(vectors, "feature_id", best[:, :k]), [float(v) for v in np.sqrt(values[:k])]


def sparse_feature_map(features: DataFrame, num_features: int, components: int = 2) -> DataFrame:
    """(feature_id, axes) in [-1, 1]: features by their activation over all rows, without hashing of rows.

    Coordinates are those of the truncated decomposition of unit features; the largest one of an axis is
    positive. Features without activation are left out.
    """
    vectors, values = sparse_svd(unit_entries(features, num_features), components)
    axes = AXES[:components] if components <= 3 else [f"d{i}" for i in range(components)]
    placed = store(vectors.select("feature_id", *[(F.col("q")[j] * values[j]).alias(a) for j, a in enumerate(axes)]), "feature-map")

    def largest(a: str) -> Column:
        return F.max_by(F.col(a), F.struct(F.abs(F.round(F.col(a), 9)), -F.col("feature_id"))).alias(a)

    peaks = placed.agg(*[largest(a) for a in axes]).first()
    signed = placed.withColumns({a: F.col(a) * (-1.0 if (peaks[a] or 0.0) < 0 else 1.0) for a in axes})
    return normalize_frame(signed, axes)

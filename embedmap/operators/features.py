"""Sparse features of vectors (FEAT*)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.knn import matrix
from embedmap.operators.ranking import top_per_group


def long_features(features: DataFrame, keys: tuple[str, ...] = ("ls_index",)) -> DataFrame:
    """(keys, feature_id, act): one row per stored activation."""
    each = features.select(*keys, F.explode(F.arrays_zip("top_indices", "top_acts")).alias("_f"))
    return each.select(*keys, F.col("_f.top_indices").alias("feature_id"), F.col("_f.top_acts").alias("act"))


def feature_stats(features: DataFrame, num: int) -> DataFrame:
    """(feature_id, max_activation, count, avg_activation) for every feature 0..num-1."""
    per = long_features(features).groupBy("feature_id").agg(
        F.greatest(F.max("act"), F.lit(0.0)).alias("max_activation"),
        F.count_if(F.col("act") > 0).alias("count"),
        F.sum("act").alias("_s"),
    )
    ids = features.sparkSession.range(num).select(F.col("id").cast("int").alias("feature_id"))
    zero = F.lit(0.0)
    return ids.join(per, "feature_id", "left").select(
        "feature_id",
        F.coalesce("max_activation", zero).alias("max_activation"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("_s", zero) / F.greatest(F.coalesce("count", F.lit(0)), F.lit(1))).alias("avg_activation"),
    )


def alive_features(stats: DataFrame) -> DataFrame:
    """One row: how many features ever fire, and how many never do."""
    return stats.agg(
        F.count_if(F.col("max_activation") > 0).alias("alive"), F.count_if(F.col("max_activation") <= 0).alias("dead")
    )


def feature_search(features: DataFrame, feature: int, threshold: float = 0.1, top: int | None = None) -> DataFrame:
    """Rows that activate a feature above the threshold, strongest first.

    The activation is taken from the arrays in place, so rows are filtered before anything moves.
    """
    mine = F.filter(F.arrays_zip("top_indices", "top_acts"), lambda p: p["top_indices"] == feature)
    act = F.array_max(F.transform(mine, lambda p: p["top_acts"]))
    found = features.select("ls_index", act.alias("act")).filter(F.col("act") > threshold)
    found = found.orderBy(F.col("act").desc(), F.col("ls_index").asc())
    return found if top is None else found.limit(top)


def encode_topk(df: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, k: int = 32, vector: str = "vector") -> DataFrame:
    """Top-k of ReLU(xW + b) per row: adds ``top_indices`` and ``top_acts``, strongest first.

    ``weights`` (dims x features) is the caller's model and travels with the tasks.
    """
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)
    k = min(k, w.shape[1])
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.arrow_udf("struct<i: array<int>, a: array<double>>")
    def encode(v: pa.Array) -> pa.Array:
        w, b = shared.value
        x = matrix(v)
        idx, acts = [], []
        for s in range(0, len(x), 1024):
            a = np.maximum(x[s : s + 1024] @ w + b, 0.0)
            order = np.argsort(-a, axis=1, kind="stable")[:, :k]
            idx.append(order.astype(np.int32))
            acts.append(np.take_along_axis(a, order, 1))
        rows = np.arange(0, len(x) * k + 1, k, dtype=np.int32)
        flat = lambda parts, t: pa.ListArray.from_arrays(
            pa.array(rows), pa.array(np.concatenate(parts).ravel() if parts else [], t)
        )
        return pa.StructArray.from_arrays([flat(idx, pa.int32()), flat(acts, pa.float64())], names=["i", "a"])

    coded = df.withColumn("_e", encode(F.col(vector)))
    return coded.withColumns({"top_indices": F.col("_e.i"), "top_acts": F.col("_e.a")}).drop("_e", vector)


def max_over_tokens(features: DataFrame, k: int) -> DataFrame:
    """Document features: per feature the strongest token, then the k strongest features."""
    per = long_features(features).groupBy("ls_index", "feature_id").agg(F.max("act").alias("act"))
    return top_per_group(per, ["ls_index"], [F.col("act").desc(), F.col("feature_id").asc()], k)


def sparse_vector(num: int) -> Column:
    """Struct (size, indices, values) of the top-k arrays, by index; repeated ids keep their last value."""
    ids, acts = F.reverse("top_indices"), F.reverse("top_acts")
    indices = F.array_sort(F.array_distinct("top_indices"))
    values = F.transform(indices, lambda i: F.element_at(acts, F.array_position(ids, i).cast("int")))
    return F.struct(F.lit(num).alias("size"), indices.alias("indices"), values.alias("values"))


def dense_vector(sparse: str) -> Column:
    """The sparse struct as an array of all its places."""
    s = F.col(sparse)
    ids = F.sequence(F.lit(0), s["size"] - 1)
    act = lambda i: F.get(s["values"], (F.array_position(s["indices"], i) - 1).cast("int"))
    return F.transform(ids, lambda i: F.when(F.array_contains(s["indices"], i), act(i)).otherwise(F.lit(0.0)))


def sae_norm(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Activations as a share of the feature's largest one in the dataset."""
    rows = long_features(features).join(stats.select("feature_id", "max_activation"), "feature_id")
    share = F.coalesce(F.try_divide(F.col("act"), F.col("max_activation")), F.lit(0.0))
    return rows.select("ls_index", "feature_id", share.alias("share"))

"""Key joins that assemble the explorable table (JOIN*).

No side is broadcast by hint: Catalyst and adaptive execution broadcast a side whose measured
size is under the session's threshold, and otherwise fall back to a sort-merge join whose skewed
partitions are split at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions import scalars as S


def with_cells(scope: DataFrame, tiles=(64, 128), voxels=(32, 64)) -> DataFrame:
    """Add the grid cell numbers a scope carries; voxels only for maps with three axes."""
    for n in tiles:
        scope = scope.withColumn(f"tile_index_{n}", S.tile_index("x", "y", n))
    if "z" in scope.columns:
        for n in voxels:
            scope = scope.withColumn(f"voxel_index_{n}", S.voxel_index("x", "y", "z", n))
    return scope


def scope_join(projection: DataFrame, clustering: DataFrame, labels: DataFrame) -> DataFrame:
    """Projection with clustering by row id and label by cluster id; nothing deleted yet."""
    return (
        projection.join(clustering, "ls_index")
        .join(labels.select("cluster", "label"), "cluster", "left")
        .withColumn("deleted", F.lit(False))
    )


def scope_input_join(source: DataFrame, scope: DataFrame) -> DataFrame:
    """Input columns beside scope columns; clashing scope columns get the suffix ``_ls``."""
    clash = [c for c in scope.columns if c in source.columns and c != "ls_index"]
    renamed = scope.withColumnsRenamed({c: f"{c}_ls" for c in clash})
    return source.join(renamed, "ls_index")


def token_parent_join(tokens: DataFrame, parents: DataFrame, request: DataFrame) -> DataFrame:
    """Requested tokens with their document's columns, in request order."""
    picked = tokens.join(request.select("token_index", "ord"), "token_index")
    picked = picked.withColumnsRenamed({"token_index": "index", "ls_index": "parent_index"})
    parent = parents.withColumnRenamed("ls_index", "parent_index")
    return picked.join(parent, "parent_index").orderBy("ord")


def attach_vectors(
    rows: DataFrame, vectors: DataFrame | None = None, features: DataFrame | None = None
) -> DataFrame:
    """Add the stored vector and top features to chosen rows."""
    if vectors is not None:
        v = vectors.select("ls_index", F.col("vector").alias("ls_embedding"))
        rows = rows.join(v, "ls_index", "left")
    if features is not None:
        f = features.select(
            "ls_index", F.col("top_acts").alias("sae_acts"), F.col("top_indices").alias("sae_indices")
        )
        rows = rows.join(f, "ls_index", "left")
    return rows


def deleted_backfill(source_ids: DataFrame, scope: DataFrame, parts: DataFrame) -> DataFrame:
    """Ids missing from the scope come back as deleted rows with their map data."""
    missing = source_ids.select("ls_index").join(scope, "ls_index", "left_anti")
    back = missing.join(parts, "ls_index").withColumn("deleted", F.lit(True))
    return scope.unionByName(back.select(*scope.columns)).orderBy("ls_index")


def tag_columns(scope: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    """One boolean ``tag_<name>`` per tag."""
    per_row = tags.groupBy("ls_index").agg(
        *[F.bool_or(F.col("tag") == n).alias(f"tag_{n}") for n in names]
    )
    joined = scope.join(per_row, "ls_index", "left")
    return joined.fillna(False, subset=[f"tag_{n}" for n in names])


def feature_label_join(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature statistics with their label, ``Feature N`` where none exists."""
    fallback = F.concat(F.lit("Feature "), F.col("feature_id").cast("string"))
    return stats.join(labels.select("feature_id", "label"), "feature_id", "left").withColumn(
        "label", F.coalesce("label", fallback)
    )


def shared_prefix(windows: list[DataFrame], cols: list[str]) -> DataFrame:
    """Rows that consecutive append-only windows share: (window, ls_index, a_*, b_*)."""
    pairs = []
    for i, (a, b) in enumerate(zip(windows, windows[1:])):
        left = a.select("ls_index", *[F.col(c).alias(f"a_{c}") for c in cols])
        right = b.select("ls_index", *[F.col(c).alias(f"b_{c}") for c in cols])
        pairs.append(left.join(right, "ls_index").withColumn("window", F.lit(i)))
    return reduce(DataFrame.unionByName, pairs)


def alignment_report(left: DataFrame, right: DataFrame, key: str = "ls_index") -> DataFrame:
    """One row: keys on the left only, on the right only, and on both sides."""
    l = left.select(key, F.lit(1).alias("l"))
    r = right.select(key, F.lit(1).alias("r"))
    return l.join(r, key, "full").agg(
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
    )


def aligned_tables_check(left: DataFrame, right: DataFrame, key: str = "ls_index") -> None:
    """Raise unless both tables hold exactly the same keys."""
    got = alignment_report(left, right, key).first()
    if got["left_only"] or got["right_only"]:
        raise ValueError(f"tables are not aligned on {key}: {got.asDict()}")


def same_granularity(*declared: str) -> str:
    """The granularity all parts of a scope agree on, else an error."""
    if len(set(declared)) != 1:
        raise ValueError(f"parts disagree on granularity: {sorted(set(declared))}")
    return declared[0]

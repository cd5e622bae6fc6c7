"""Edits of a scope and their log (CUR*), and row tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.operators.cluster import cluster_hulls
from embedmap.operators.sets import tag_subtract, tag_union


def _mark(scope: DataFrame, ids: DataFrame, flag: str = "_hit") -> DataFrame:
    return scope.join(ids.select("ls_index").distinct().withColumn(flag, F.lit(True)), "ls_index", "left")


def change_cluster(scope: DataFrame, ids: DataFrame, cluster: int, label: str) -> DataFrame:
    """Move rows to a cluster."""
    hit = F.coalesce("_hit", F.lit(False))
    return _mark(scope, ids).withColumns(
        {
            "cluster": F.when(hit, cluster).otherwise(F.col("cluster")),
            "label": F.when(hit, label).otherwise(F.col("label")),
        }
    ).drop("_hit")


def rename_cluster(scope: DataFrame, cluster: int, label: str) -> DataFrame:
    """New label for all rows of a cluster (also works on the label table)."""
    return scope.withColumn("label", F.when(F.col("cluster") == cluster, label).otherwise(F.col("label")))


def delete_rows(scope: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark rows deleted; nothing is removed."""
    gone = F.coalesce("_hit", F.lit(False)) | F.col("deleted")
    return _mark(scope, ids).withColumn("deleted", gone).drop("_hit")


def rehull(scope: DataFrame) -> DataFrame:
    """Hulls of the current clusters over rows that are not deleted."""
    return cluster_hulls(scope.filter(~F.col("deleted")), "cluster")


def replay(scope: DataFrame, labels: DataFrame, log: DataFrame) -> DataFrame:
    """Apply a transaction log (seq, action, ids, cluster, label) to a rebuilt scope.

    The last change of a row decides its cluster, the last rename of that cluster its label, and
    any delete marks it. ``labels`` is the label table (cluster, label) before the log. A hot row
    costs nothing extra: its events are reduced to one before the join.
    """
    touched = log.select("seq", "action", "cluster", F.explode("ids").alias("ls_index"))
    move = F.col("action") == "change_cluster"
    per_row = touched.groupBy("ls_index").agg(
        F.max_by(F.when(move, F.col("cluster")), F.when(move, F.col("seq"))).alias("_moved"),
        F.bool_or(F.col("action") == "delete_rows").alias("_gone"),
    )
    renamed = log.filter("action = 'change_cluster_name'").groupBy("cluster").agg(F.max_by("label", "seq").alias("_name"))
    base = labels.select("cluster", F.col("label").alias("_base"))
    moved = scope.join(per_row, "ls_index", "left").withColumn("cluster", F.coalesce("_moved", "cluster"))
    named = moved.join(base, "cluster", "left").join(renamed, "cluster", "left")
    kept = F.when(F.col("_moved").isNotNull(), F.coalesce("_base", "label")).otherwise(F.col("label"))
    return named.withColumns(
        {"label": F.coalesce("_name", kept), "deleted": F.col("deleted") | F.coalesce("_gone", F.lit(False))}
    ).drop("_moved", "_gone", "_name", "_base")


def tag_add(tags: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    return tag_union(tags, ids.select(F.lit(tag).alias("tag"), "ls_index"))


def tag_remove(tags: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    return tag_subtract(tags, ids.select(F.lit(tag).alias("tag"), "ls_index"))


def tag_delete(tags: DataFrame, tag: str) -> DataFrame:
    return tags.filter(F.col("tag") != tag)

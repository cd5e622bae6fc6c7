"""Set operations over rows and row ids (SET*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def candidate_union(*searches: DataFrame) -> DataFrame:
    """Distinct ids found by any of several searches."""
    ids = [s.select("ls_index") for s in searches]
    return reduce(DataFrame.union, ids).distinct()


def ids_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("ls_index"), "ls_index", "left_anti")


def neighbor_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per row the sizes of intersection and union of two neighbour lists (ls_index, neighbor)."""
    both = a.select("ls_index", "neighbor", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select("ls_index", "neighbor", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per = both.groupBy("ls_index", "neighbor").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.groupBy("ls_index").agg(
        F.sum(F.col("l") * F.col("r")).alias("n_common"), F.count("*").alias("n_union")
    )


def tag_union(tags: DataFrame, more: DataFrame) -> DataFrame:
    """Add ids to tags; ids already there are kept once."""
    return tags.select("tag", "ls_index").union(more.select("tag", "ls_index")).distinct()


def tag_subtract(tags: DataFrame, less: DataFrame) -> DataFrame:
    return tags.join(less.select("tag", "ls_index"), ["tag", "ls_index"], "left_anti")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()

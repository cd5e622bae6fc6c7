"""Row filters (FLT*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.functions.common import col


def column_filter(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """AND of ``{type, column, value}`` conditions; ``contains`` is a regular expression search.

    Conditions of an unknown type are ignored; null never matches. The filters stay plain
    predicates, so simple comparisons reach the scan.
    """
    build = {
        "eq": lambda c, v: c == v,
        "gt": lambda c, v: c > v,
        "lt": lambda c, v: c < v,
        "gte": lambda c, v: c >= v,
        "lte": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(list(v)),
        "contains": lambda c, v: c.cast("string").rlike(v),
    }
    for cond in conditions:
        make = build.get(cond["type"])
        if make is not None:
            df = df.filter(make(F.col(cond["column"]), cond["value"]))
    return df


def by_cluster(scope: DataFrame, cluster: int) -> DataFrame:
    return scope.filter(F.col("cluster") == cluster)


def not_deleted(scope: DataFrame) -> DataFrame:
    return scope.filter(~F.col("deleted"))


def by_indices(df: DataFrame, request: DataFrame) -> DataFrame:
    """Rows named by ``request(ls_index, ord)`` in request order; unknown ids fall away."""
    return df.join(request.select("ls_index", "ord"), "ls_index").orderBy("ord")


def viewport(df: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points inside a rectangle given by two opposite corners, in any order."""
    return df.filter(
        F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    )


def curate_rows(df: DataFrame, text: str, score: str, min_score: float = 5) -> DataFrame:
    """Well-scored text that is present and carries no links."""
    t = F.col(text)
    # fixed values: the link marks that disqualify a row
    links = ["imgur", "http:", "https:"]
    clean = t.isNotNull() & (t != "")
    for mark in links:
        clean = clean & ~t.contains(mark)
    return df.filter((F.col(score) > min_score) & clean)


def search_labels(
    labels: DataFrame, query: str, top: int = 5, name: str = "label", ident: str | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """Rows whose label (or id, for features) contains the query, ignoring case."""
    needle = query.lower()
    hit = F.contains(F.lower(F.col(name)), F.lit(needle))
    if ident is not None:
        hit = hit | F.contains(F.col(ident).cast("string"), F.lit(needle))
    return labels.filter(hit).orderBy(*(order or [F.col(name).asc()])).limit(top)


def above_threshold(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Add ``above``: the value reaches the threshold."""
    return df.withColumn("above", F.coalesce(F.col(value) >= threshold, F.lit(False)))


def count_above(df: DataFrame, value: str, threshold: float) -> DataFrame:
    flagged = above_threshold(df, value, threshold)
    return flagged.agg(F.count_if("above").alias("n_above"), F.count("*").alias("n"))


def valid_category(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Rows whose value is a known category of a column that has more than one.

    ``categories`` is the long table (column, value, n) of ``profile.categories``.
    """
    own = categories.filter(F.col("column") == column)
    several = own.agg((F.count("*") > 1).alias("ok")).scalar()
    values = own.select(F.col("value").alias(column))
    return df.join(values, column, "left_semi").filter(several)


def out_of_frame(df: DataFrame, axes: list[str], lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """One row: how many points leave [lo, hi] on any axis."""
    outside = F.lit(False)
    for a in axes:
        outside = outside | (col(a) < lo) | (col(a) > hi)
    return df.agg(F.count_if(outside).alias("n_outside"), F.count("*").alias("n"))

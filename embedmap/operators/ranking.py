"""Ranking, sampling and paging (WIN*, SMP*, SRT*).

Two shapes of rank exist. ``top_per_group`` keeps a bounded number of rows per group, which Spark
cuts down before the shuffle, so a hot group costs little. ``running_in_group`` needs the exact
position of every row; it splits the order itself into ranges so that one group holding a third
of the table is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedmap.functions.common import col
from embedmap.functions.scalars import tile_index
from embedmap.session import cut_lineage, store

# Spark limits groups before the shuffle only up to this many rows per group
# (spark.sql.optimizer.windowGroupLimitThreshold)
GROUP_LIMIT = 1000
# a sample of up to this many rows is merged in one task
DIRECT_SAMPLE = 100_000


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group, with their 1-based rank."""
    if n <= GROUP_LIMIT:
        w = W.partitionBy(*group).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    ranked = running_in_group(df, group, order)
    return ranked.filter(F.col("position") < n).withColumn(
        rank, (F.col("position") + 1).cast("int")
    ).drop("position")


def running_in_group(
    df: DataFrame, group: list[str], order: list, value: str | None = None
) -> DataFrame:
    """Exact 0-based ``position`` in each group, and ``running`` total of ``value`` if given.

    ``order`` must be unique within a group. Rows are range-partitioned by group and order; every
    range counts for itself and the totals of earlier ranges are added.
    """
    amount = col(value) if value is not None else F.lit(1)
    cut = df.repartitionByRange(*[F.col(g) for g in group], *order)
    cut = cut_lineage(cut.withColumn("_range", F.spark_partition_id()))
    keys = ["_range", *group]
    w = W.partitionBy(*keys).orderBy(*order)
    local = cut.withColumn("_pos", F.row_number().over(w) - 1).withColumn(
        "_run", F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    totals = cut.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(amount).alias("_sum"))
    # one row per range of a group, so at most the number of partitions in one window
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"),
    )
    out = local.join(offsets, keys).withColumn("position", F.col("_pos") + F.col("_n0"))
    if value is not None:
        out = out.withColumn("running", F.col("_run") + F.col("_sum0"))
    return out.drop("_range", "_pos", "_run", "_n0", "_sum0")


def assign_row_index(df: DataFrame, order: list | None = None, name: str = "ls_index") -> DataFrame:
    """Dense 0-based row number in the given order, input order breaking ties.

    Range sort, count per range, add the counts of earlier ranges: no single-task window over
    the table. The sorted table is checkpointed because range bounds come from a sample.
    """
    keys = [*(order or []), F.col("_seq").asc()]
    placed = df.withColumn("_seq", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()).drop("_seq"))
    bits = 33  # monotonically_increasing_id keeps the row in the low 33 bits
    placed = placed.withColumn("_range", F.shiftright("_at", bits))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    # size bound: one 16-byte row per partition of the table
    out = placed.join(F.broadcast(offsets), "_range")
    row = F.col("_at").bitwiseAND(F.lit((1 << bits) - 1)) + F.col("_n0")
    return out.select(row.alias(name), *[c for c in df.columns if c != name])


def nearest_to_centroid(scope: DataFrame, n: int) -> DataFrame:
    """Per cluster the ``n`` members nearest the centroid of its raw members.

    Clusters with at most ``n`` rows (or ``n`` = 0) keep all members. When fewer than ``n`` raw
    members exist, the pool is the raw members followed by all members, and a row found in both
    counts twice until after the cut. Ranking moves keys and coordinates only; other columns
    (texts) are joined to the few rows that are kept.
    """
    if n <= 0:
        return scope.withColumn("centroid_dist", F.lit(None).cast("double"))
    points = scope.select("ls_index", "cluster", "raw_cluster", "x", "y")
    raw = F.col("raw_cluster") == F.col("cluster")
    sizes = points.groupBy("cluster").agg(
        F.count("*").alias("_size"),
        F.count_if(raw).alias("_raw"),
        F.sum("x").alias("_ax"), F.sum("y").alias("_ay"),
        F.sum(F.when(raw, F.col("x"))).alias("_rx"), F.sum(F.when(raw, F.col("y"))).alias("_ry"),
    )
    enough = F.col("_raw") >= n
    pool = F.when(enough, 0).otherwise(F.col("_size")) + F.col("_raw")

    def mean(every: str, own: str) -> Column:
        return (F.when(enough, 0.0).otherwise(F.col(every)) + F.coalesce(F.col(own), F.lit(0.0))) / pool

    # stored, so the planner knows its size and can broadcast it instead of shuffling the points
    sizes = store(
        sizes.select("cluster", "_size", enough.alias("_enough"), mean("_ax", "_rx").alias("_cx"), mean("_ay", "_ry").alias("_cy")),
        "cluster-sizes",
    )
    rows = points.join(sizes, "cluster")
    dist = F.sqrt((F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2)
    rows = rows.withColumn("_small", F.col("_size") <= n).withColumn(
        "centroid_dist", F.when(~F.col("_small"), dist)
    )
    # how often a row stands in the pool, 0 if it is no candidate
    copies = (
        F.when(F.col("_small"), 1)
        .when(F.col("_enough"), raw.cast("int"))
        .otherwise(1 + raw.cast("int"))
    )
    pooled = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter(
        F.col("_copy") <= copies
    )
    order = [F.col("centroid_dist").asc_nulls_last(), "ls_index", "_copy"]
    kept = top_per_group(pooled, ["cluster"], order, n, "_rank").filter("_copy = 1")
    kept = store(kept.select("ls_index", "centroid_dist"), "central-members")
    return scope.join(kept, "ls_index")


def token_budget(
    items: DataFrame, group: list[str], order: list, tokens: str, per_item: int, total: int
) -> DataFrame:
    """Cut every item to ``per_item`` tokens and keep items while the running sum fits ``total``.

    Sums only grow, so keeping rows whose running sum fits equals stopping at the first misfit.
    A limit of 0 is no limit.
    """
    used = F.least(F.col(tokens), F.lit(per_item)) if per_item > 0 else F.col(tokens)
    items = items.withColumn("used_tokens", used.cast("long"))
    if total <= 0:
        return items
    running = running_in_group(items, group, order, "used_tokens")
    return running.filter(F.col("running") <= total).drop("position")


def first_k_per_cell(scope: DataFrame, image: str, resolutions: list[int], k: int) -> DataFrame:
    """(resolution, cell, ls_index, sheet): the first ``k`` usable images per grid cell in row order.

    ``sheet`` 0..k-1 is the position within the cell. Images themselves are not moved; join them
    to the result by row id.
    """
    live = scope.filter(~F.col("deleted") & F.col(image).isNotNull()).select("ls_index", "x", "y")
    at = live.withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in sorted(set(resolutions))])))
    at = at.select("resolution", tile_index("x", "y", F.col("resolution")).alias("cell"), "ls_index")
    top = top_per_group(at, ["resolution", "cell"], ["ls_index"], k)
    return top.withColumn("sheet", F.col("rank") - 1).drop("rank")


def sample_even(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """``k`` evenly spread rows per group: positions floor(j*n/k)."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    ranked = running_in_group(df, group, order).join(sizes, group)
    n, r = F.col("_n"), F.col("position")
    j = F.floor((r * k + n - 1) / n)  # smallest j whose position is not before r
    hit = (n <= k) | ((j < k) & (F.floor(j * n / k) == r))
    return ranked.filter(hit).drop("_n")


def token_offsets(docs: DataFrame, num_tokens: str = "num_tokens") -> DataFrame:
    """First global token number of every document, in ``ls_index`` order."""
    run = running_in_group(docs, [], ["ls_index"], num_tokens)
    return run.withColumn("first_token", F.col("running") - F.col(num_tokens)).drop("running", "position")


def recent_distinct(df: DataFrame, key: str, ts: str, k: int = 5) -> DataFrame:
    """The ``k`` most recently seen keys."""
    last = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return last.orderBy(F.col("last_seen").desc(), F.col(key).asc()).limit(k)


def uniform_sample(df: DataFrame, n: int, seed: int = 42, key: str = "ls_index") -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones on every run.

    The sample is the ``n`` lowest hashed keys. A small one is a plain top-n. For a large one a
    bound on the hash first keeps little more than ``n`` rows, and only those are sorted and
    numbered, in many tasks; should the bound keep too few, all rows are.
    """
    # sixty bits of a digest
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    if n <= DIRECT_SAMPLE:
        return df.orderBy(h, key).limit(n)
    total = df.count()
    if n >= total:
        return df
    share = (1.2 * n + 1000) / total
    some = df if share >= 1 else df.filter(h < F.lit(int(share * 2**60)))
    if share < 1 and some.count() < n:
        some = df
    numbered = assign_row_index(some.withColumn("_h", h), [F.col("_h"), F.col(key)], "_order")
    return numbered.filter(F.col("_order") < n).select(*df.columns)


def sort_rows(df: DataFrame, column: str, ascending: bool = True, tie: str = "ls_index") -> DataFrame:
    """Sort by one column, nulls last either way."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), tie)


def positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Rows of a sorted frame with their position in it: partitions are in order, so counts before each add up."""
    numbered = store(df.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before")
    return numbered.withColumn("_part", part).join(before.drop("_n"), "_part").withColumn(name, at).drop("_part", "_at", "_before")


def page(df: DataFrame, order: list, number: int, per_page: int = 100) -> DataFrame:
    """One page of ordered rows (0-based page number)."""
    return df.orderBy(*order).offset(number * per_page).limit(per_page)


def page_after(df: DataFrame, order: list[str], last: list | None, per_page: int = 100) -> DataFrame:
    """The page after the row whose ascending ``order`` columns, unique together and never null, are ``last``.

    However deep the page, only rows behind the key are looked at and a top-n is kept.
    """
    if last is not None:
        behind = F.lit(False)
        for name, value in reversed(list(zip(order, last, strict=True))):
            behind = (F.col(name) > value) | ((F.col(name) == value) & behind)
        df = df.filter(behind)
    return df.orderBy(*order).limit(per_page)


def page_count(df: DataFrame, per_page: int = 100) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.ceil(F.count("*") / per_page).alias("total_pages")
    )


def head(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def order_clusters(summary: DataFrame, mode: str = "size") -> DataFrame:
    """Cluster list ordered by size (largest first), label or id."""
    orders = {
        "size": [F.col("count").desc(), F.col("cluster").asc()],
        "label": [F.col("label").asc(), F.col("cluster").asc()],
        "id": [F.col("cluster").asc()],
    }
    return summary.orderBy(*orders[mode])

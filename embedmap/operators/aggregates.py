"""Aggregations over a scope (AGG*) and grid planning (GRD*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions import scalars as S
from embedmap.operators.ranking import assign_row_index
from embedmap.session import store


def cluster_summary(scope: DataFrame) -> DataFrame:
    """Rows per cluster, for clusters with at least one row that is not deleted."""
    # counted by label first: a string minimum over all rows would need a sort, this needs a hash
    part = scope.groupBy("cluster", "label").agg(F.count("*").alias("_n"), F.count_if(~F.col("deleted")).alias("_live"))
    per = part.groupBy("cluster").agg(
        F.min("label").alias("label"), F.sum("_n").alias("count"), F.sum("_live").alias("live")
    )
    return per.filter(F.col("live") > 0)


def cluster_centroids(scope: DataFrame) -> DataFrame:
    return scope.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def tile_density(scope: DataFrame, cell: str) -> DataFrame:
    return scope.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n"))


def cell_dominant(scope: DataFrame, cell: str) -> DataFrame:
    """Per cell its row count and most frequent cluster, ties to the lowest id."""
    # hash counts of all rows, then labels and the winner on the small table of counts
    part = scope.groupBy(F.col(cell).alias("cell"), "cluster", "label").agg(F.count("*").alias("_n"))
    per = part.groupBy("cell", "cluster").agg(F.sum("_n").alias("_n"), F.min("label").alias("label"))
    best = F.max_by(F.struct("cluster", "label"), F.struct(F.col("_n"), -F.col("cluster")))
    return (
        per.groupBy("cell")
        .agg(F.sum("_n").alias("n"), best.alias("_b"))
        .select("cell", "n", F.col("_b.cluster").alias("cluster"), F.col("_b.label").alias("label"))
    )


def voxel_cells(scope: DataFrame, n: int) -> DataFrame:
    """Dominant cluster, centre and log density of every occupied voxel; deleted rows skipped."""
    # at most n^3 rows, needed for the maximum and for the rows
    cells = store(cell_dominant(scope.filter(~F.col("deleted")), f"voxel_index_{n}"), "voxels")
    top = cells.agg(F.max("n")).scalar()
    at = S.voxel_center("cell", n)
    return cells.select(
        "cell", "n", "cluster", "label",
        at.getField("x").alias("x"), at.getField("y").alias("y"), at.getField("z").alias("z"),
        (F.log1p(F.col("n")) / F.log1p(top)).alias("density"),
    )


def selection_spread(maps: dict[str, DataFrame], selected: DataFrame) -> DataFrame:
    """Bounding-box diagonal of the selected ids in each map."""
    out = None
    for name, points in maps.items():
        row = points.join(selected.select("ls_index"), "ls_index", "left_semi").agg(
            F.lit(name).alias("map"),
            F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def color_categories(df: DataFrame, column: str) -> DataFrame:
    """Distinct values numbered by falling frequency: (value, n, category)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    return assign_row_index(counts, [F.col("n").desc(), F.col("value").asc()], "category")


def color_categorical(df: DataFrame, column: str, categories: DataFrame | None = None) -> DataFrame:
    """Category number per row, -1 for a missing value."""
    # stored, so the planner knows its size and can broadcast it
    cats = categories if categories is not None else store(color_categories(df, column), "categories")
    lookup = cats.select(F.col("value").alias(column), "category")
    return df.join(lookup, column, "left").withColumn("category", F.coalesce("category", F.lit(-1)))


def color_numeric(df: DataFrame, column: str, extent: tuple[float, float] | None = None) -> DataFrame:
    """Value as a number (null if it is none) with the stored or the finite extent."""
    v = F.col(column).try_cast("double")
    rows = df.withColumn("value", v)
    if extent is not None:
        return rows.withColumn("lo", F.lit(extent[0])).withColumn("hi", F.lit(extent[1]))
    finite = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    ext = df.agg(F.struct(F.min(finite).alias("lo"), F.max(finite).alias("hi"))).scalar()
    return rows.withColumn("lo", ext.getField("lo")).withColumn("hi", ext.getField("hi"))


def rare_label_fold(df: DataFrame, label: str, threshold: int) -> DataFrame:
    """Labels with fewer rows than the threshold become "No Topic"; below 0 nothing changes."""
    if threshold < 0:
        return df.withColumn("folded", F.col(label))
    rare = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") < threshold)
    rare = store(rare.select(label, F.lit(True).alias("_rare")), "rare-labels")
    folded = F.when(F.col("_rare"), "No Topic").otherwise(F.col(label))
    return df.join(rare, label, "left").withColumn("folded", folded).drop("_rare")


def scope_fingerprint(scope: DataFrame) -> DataFrame:
    """One-row content hash of the live points at a millionth of the map's unit, independent of row order.

    Sixty bits of each row's digest, combined by xor, and the low 32 bits summed.
    """
    spot = [F.floor(F.col(a) * 1e6 + 0.5).cast("long") for a in ("x", "y")]
    h = F.conv(F.substring(F.md5(F.concat_ws(",", "ls_index", *spot)), 1, 15), 16, 10).cast("long")
    return scope.filter(~F.col("deleted")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("hash_sum"),
    )


def cluster_members(scope: DataFrame) -> DataFrame:
    """Members in long form; a cluster is never packed into one row."""
    return scope.select("cluster", "ls_index")


# --- grid planning ------------------------------------------------------------------------


def _cells_at(points: DataFrame, resolutions: list[int], cell_px: int, tile_px: int) -> DataFrame:
    """Occupied cells per resolution with their image tile and row count."""
    rs = F.array(*[F.lit(r) for r in sorted(set(resolutions))])
    r = F.col("resolution")
    cells = (
        points.select("x", "y", F.explode(rs).alias("resolution"))
        .groupBy("resolution", S.tile_index("x", "y", r).alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    tile = S.image_tile("cell", r, cell_px, tile_px)
    return cells.withColumn("tx", tile.getField("tx")).withColumn("ty", tile.getField("ty"))


def plan_grid(points: DataFrame, resolutions: list[int], cell_px: int = 32, tile_px: int = 2048) -> DataFrame:
    """Per resolution how an image pyramid would tile: totals and populated counts.

    Cells are counted once per cell, not per row, so the distinct counts run on the small table.
    """
    cells = _cells_at(points, resolutions, cell_px, tile_px)
    r = F.col("resolution")
    axis = F.ceil(r * cell_px / F.lit(max(tile_px, cell_px))).cast("long")
    per = cells.groupBy("resolution").agg(
        F.count("*").alias("populated_cells"),
        F.count_distinct("tx", "ty").alias("populated_tiles"),
        F.sum("n").alias("points"),
    )
    return per.select(
        "resolution",
        axis.alias("tiles_per_axis"),
        (r * cell_px).cast("long").alias("full_px"),
        (r * r).cast("long").alias("total_cells"),
        "populated_cells",
        (axis * axis).alias("total_tiles"),
        "populated_tiles",
        "points",
    )


def tile_counts(points: DataFrame, resolutions: list[int], cell_px: int = 32, tile_px: int = 2048) -> DataFrame:
    """Populated image tiles with the number of filled cells."""
    cells = _cells_at(points, resolutions, cell_px, tile_px)
    per = cells.groupBy("resolution", "tx", "ty").agg(F.count("*").alias("filled_cells"))
    return per.orderBy("resolution", "tx", "ty")


def density_grid(points: DataFrame, res: int = 64) -> DataFrame:
    """Counts for every cell of a res x res grid, empty cells included."""
    grid = points.sparkSession.range(res * res).withColumnRenamed("id", "cell")
    counts = points.groupBy(S.tile_index("x", "y", res).alias("cell")).agg(F.count("*").alias("n"))
    return grid.join(counts, "cell", "left").select(
        "cell",
        F.floor(F.col("cell") / res).alias("row"),
        (F.col("cell") % res).alias("col"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def bytes_per_cell(df: DataFrame, image: str) -> DataFrame:
    """Mean stored size of the images there are, and their number."""
    size = F.octet_length(image)
    return df.agg(F.avg(size).alias("bytes_per_cell"), F.count(size).alias("images"))

"""Maps and frames of reference (PRJ*)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions.vectors import l2_normalize
from embedmap.operators.joins import aligned_tables_check, shared_prefix
from embedmap.operators.knn import Prepared, knn_join
from embedmap.operators.ranking import uniform_sample
from embedmap.session import store

AXES = ["x", "y", "z"]


def frame_bounds(df: DataFrame, axes: list[str]) -> dict[str, float]:
    """Min and max per axis: one aggregate row, used as plain constants afterwards."""
    parts = []
    for a in axes:
        parts += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max")]
    return df.agg(*parts).first().asDict()


def apply_frame(df: DataFrame, axes: list[str], bounds: dict[str, float]) -> DataFrame:
    """Scale axes by stored bounds; new points may leave [-1, 1]. A flat axis becomes 0."""
    scaled = {}
    for a in axes:
        lo, hi = bounds[f"{a}_min"], bounds[f"{a}_max"]
        flat = lo is None or lo == hi
        scaled[a] = F.col(a) * 0.0 if flat else 2 * (F.col(a) - F.lit(lo)) / F.lit(hi - lo) - 1
    return df.withColumns(scaled)


def normalize_frame(df: DataFrame, axes: list[str]) -> DataFrame:
    """Scale every axis to [-1, 1] by its own extent."""
    return apply_frame(df, axes, frame_bounds(df, axes))


def fit_similarity(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Least-squares scale, rotation or reflection, and translation from (sx, sy) to (dx, dy).

    One aggregate row (per group): c, r11, r12, r21, r22, tx, ty, n. The orthogonal part is the
    polar factor of the 2x2 covariance in closed form: of the best rotation and the best
    reflection, the one with the larger gain. Raises on fewer than two points or equal points.
    """
    cov = lambda d, s: F.covar_pop(d, s)
    agg = pairs.groupBy(*(group or [])).agg(
        F.count("*").alias("n"),
        F.avg("sx").alias("ms_x"), F.avg("sy").alias("ms_y"),
        F.avg("dx").alias("md_x"), F.avg("dy").alias("md_y"),
        cov("dx", "sx").alias("a"), cov("dx", "sy").alias("b"),
        cov("dy", "sx").alias("c_"), cov("dy", "sy").alias("d"),
        (F.var_pop("sx") + F.var_pop("sy")).alias("var"),
    )
    bad = (F.col("n") < 2) | ~(F.col("var") > 0)
    agg = agg.withColumn(
        "var",
        F.when(bad, F.raise_error(F.lit("need two shared points that differ"))).otherwise(F.col("var")),
    )
    rot = F.hypot(F.col("a") + F.col("d"), F.col("c_") - F.col("b"))
    ref = F.hypot(F.col("a") - F.col("d"), F.col("c_") + F.col("b"))
    agg = agg.withColumn("rot", rot).withColumn("ref", ref)
    turn = F.col("rot") >= F.col("ref")
    pick = lambda p, q, fallback: F.coalesce(
        F.when(turn, F.try_divide(p, F.col("rot"))).otherwise(F.try_divide(q, F.col("ref"))), F.lit(fallback)
    )
    a, b, c, d = (F.col(k) for k in ("a", "b", "c_", "d"))
    fit = agg.withColumns(
        {
            "c": F.greatest("rot", "ref") / F.col("var"),
            "r11": pick(a + d, a - d, 1.0),
            "r12": pick(b - c, b + c, 0.0),
            "r21": pick(c - b, b + c, 0.0),
            "r22": pick(a + d, d - a, 1.0),
        }
    )
    fit = fit.withColumn(
        "tx", F.col("md_x") - F.col("c") * (F.col("r11") * F.col("ms_x") + F.col("r12") * F.col("ms_y"))
    ).withColumn(
        "ty", F.col("md_y") - F.col("c") * (F.col("r21") * F.col("ms_x") + F.col("r22") * F.col("ms_y"))
    )
    return fit.select(*(group or []), "c", "r11", "r12", "r21", "r22", "tx", "ty", "n")


def apply_similarity(df: DataFrame, fit: DataFrame) -> DataFrame:
    """Move x, y by a one-row fit."""
    f = fit.first()
    x, y = F.col("x"), F.col("y")
    return df.withColumns(
        {
            "x": f["c"] * (f["r11"] * x + f["r12"] * y) + f["tx"],
            "y": f["c"] * (f["r21"] * x + f["r22"] * y) + f["ty"],
        }
    )


def register_layout(new: DataFrame, target: DataFrame) -> DataFrame:
    """Move a layout onto a target: fit on the rows both hold, apply to all rows."""
    shared = shared_prefix([new, target], ["x", "y"]).select(
        F.col("a_x").alias("sx"), F.col("a_y").alias("sy"), F.col("b_x").alias("dx"), F.col("b_y").alias("dy")
    )
    return apply_similarity(new, fit_similarity(shared))


def align_layouts(layouts: list[DataFrame]) -> DataFrame:
    """Layouts of several windows in the frame of the first, each registered on the one before."""
    placed = [layouts[0]]
    for layout in layouts[1:]:
        placed.append(register_layout(layout, placed[-1]))
    marked = [p.withColumn("window", F.lit(i)) for i, p in enumerate(placed)]
    return reduce(DataFrame.unionByName, marked)


def _axes(components: int) -> list[str]:
    return AXES[:components] if components <= 3 else [f"d{i}" for i in range(components)]


def fit_pca(df: DataFrame, vector: str, components: int) -> PCAModel:
    unit = df.select(array_to_vector(l2_normalize(vector)).alias("_u"))
    return PCA(k=components, inputCol="_u", outputCol="_p").fit(unit)


def pca_transform(df: DataFrame, model: PCAModel, vector: str) -> DataFrame:
    """Apply a fitted projection, scale to [-1, 1] and drop the vector.

    The few map columns are stored, so vectors are read once and not again for the extent.
    """
    loadings = model.pc.toArray()
    # signs are arbitrary in PCA: make the largest loading of each axis positive
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(loadings.shape[1])]
    axes = _axes(loadings.shape[1])
    unit = df.withColumn("_u", array_to_vector(l2_normalize(vector)))
    at = vector_to_array("_p")
    placed = model.transform(unit).withColumns({a: at[j] * signs[j] for j, a in enumerate(axes)})
    return normalize_frame(store(placed.drop("_u", "_p", vector), "projection"), axes)


def project(df: DataFrame, vector: str = "vector", components: int = 2) -> DataFrame:
    """Linear map of unit vectors to 1, 2 or 3 axes in [-1, 1]."""
    rows = df.select("ls_index", vector)
    return pca_transform(rows, fit_pca(rows, vector, components), vector)


def project_sample(df: DataFrame, vector: str, fit_sample: int, components: int = 2, key: str = "ls_index") -> DataFrame:
    """Fit on a fixed sample of rows (token maps), place every row."""
    model = fit_pca(uniform_sample(df, fit_sample, key=key), vector, components)
    return pca_transform(df, model, vector)


def project_features(features: DataFrame, num_features: int, hashed_dims: int, components: int = 2) -> DataFrame:
    """Map of the features themselves: each feature is its (hashed) activation over rows.

    Rows are hashed into at most ``hashed_dims`` signed buckets, so a feature's vector stays
    narrow however many rows exist; features without activation are left out.
    """
    acts = features.select(
        "ls_index", F.explode(F.arrays_zip("top_indices", "top_acts")).alias("f")
    ).select("ls_index", F.col("f.top_indices").alias("feature_id"), F.col("f.top_acts").alias("act"))
    acts = acts.filter((F.col("act") > 0) & (F.col("feature_id") < num_features))
    h = F.xxhash64("ls_index")
    sign = F.when(h.bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    cells = acts.groupBy("feature_id", F.pmod(F.shiftright(h, 1), F.lit(hashed_dims)).alias("d")).agg(
        F.sum(F.col("act") * sign).alias("w")
    )
    # a feature has at most hashed_dims cells, so the map below is bounded
    packed = cells.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("m"))
    dims = F.sequence(F.lit(0).cast("long"), F.lit(hashed_dims - 1).cast("long"))
    dense = packed.select(
        F.col("feature_id").alias("ls_index"),
        F.transform(dims, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vector"),
    )
    return project(dense, "vector", components).withColumnRenamed("ls_index", "feature_id")


def place_near(old_map: DataFrame, old: DataFrame | Prepared, fresh: DataFrame, k: int = 15) -> DataFrame:
    """Coordinates of new (ls_index, vector) rows: the similarity-weighted mean of their neighbours on the map."""
    near = knn_join(fresh, old, k, metric="cosine")
    axes = [c for c in AXES if c in old_map.columns]
    at = old_map.select(F.col("ls_index").alias("neighbor"), *axes)
    weight = F.greatest(1 - F.col("distance"), F.lit(1e-6))
    return near.join(at, "neighbor").groupBy("ls_index").agg(
        *[(F.sum(weight * F.col(a)) / F.sum(weight)).alias(a) for a in axes]
    )


def place_new_rows(old_map: DataFrame, old: DataFrame, new: DataFrame, k: int = 15) -> DataFrame:
    """Old coordinates unchanged, new rows at the similarity-weighted mean of their neighbours.

    ``old`` and ``new`` are (ls_index, vector). Raises when the map has rows the old vectors lack.
    """
    aligned_tables_check(old_map, old)
    fresh = new.join(old_map, "ls_index", "left_anti")
    axes = [c for c in AXES if c in old_map.columns]
    return old_map.select("ls_index", *axes).unionByName(place_near(old_map, old, fresh, k))

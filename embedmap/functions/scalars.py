"""Row-wise text, grid and colour functions (FN*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.functions.common import clip, col

# --- text -------------------------------------------------------------------------------


def prepare_text(c, prefix: str = "") -> Column:
    """Null and empty become one space; anything else is cast to string; prefix in front."""
    text = col(c).cast("string")
    return F.concat(F.lit(prefix), F.when(text.isNull() | (text == ""), " ").otherwise(text))


def clean_label(c) -> Column:
    """Tidy a generated label: drop markup, collapse whitespace, first five words."""
    # fixed values: the marks a chat model tends to leave in a label
    marks = r"<\|eot_id\|>|[*\"']"
    flat = F.trim(F.regexp_replace(F.regexp_replace(col(c), marks, ""), r"\s+", " "))
    return F.array_join(F.slice(F.split(flat, " "), 1, 5), " ")


def display_token(c) -> Column:
    """Token without subword marks at its head; the token itself if nothing is left."""
    bare = F.regexp_replace(col(c), "^[▁Ġ]+", "")
    bare = F.regexp_replace(bare, "^##", "")
    return F.when(bare == "", col(c)).otherwise(bare)


def clean_token(c) -> Column:
    """Token without any run of leading subword marks."""
    # fixed values: the marks of common subword tokenizers
    return F.regexp_replace(col(c), "^(?:##|▁|Ġ)+", "")


def token_snippet(text, start, end, window: int = 150) -> Column:
    """Struct of the text around a 0-based half-open span.

    An end beyond the text is its end; null for a span that is inverted or starts at or after the end.
    """
    text, start, end = col(text), col(start), col(end)
    n = F.length(text)
    lo = F.greatest(start - window, F.lit(0))
    end = F.least(end, n)
    hi = F.least(end + window, n)
    snippet = F.struct(
        F.substring(text, lo + 1, start - lo).alias("before"),
        F.substring(text, start + 1, end - start).alias("match"),
        F.substring(text, end + 1, hi - end).alias("after"),
        (lo > 0).alias("cut_before"),
        (hi < n).alias("cut_after"),
    )
    return F.when((start >= 0) & (end >= start) & (start < n), snippet)


def repeated_words(c, threshold: int = 100) -> Column:
    """True if one whitespace-separated word occurs more than ``threshold`` times; null is false.

    Equal words are neighbours once sorted, so such a word stands ``threshold`` places before itself. Only
    texts with ``threshold`` words more than distinct ones are sorted; the others cannot have one.
    """
    words = F.array_remove(F.split(col(c), r"\s+"), "")
    ordered = F.array_sort(words)
    ahead = F.slice(ordered, threshold + 1, F.greatest(F.size(words) - threshold, F.lit(0)))
    found = F.exists(F.zip_with(ahead, ordered, lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))
    return F.coalesce(F.when(F.size(words) - F.size(F.array_distinct(words)) >= threshold, found), F.lit(False))


# --- grids ------------------------------------------------------------------------------


def grid_bin(c, n) -> Column:
    """Bin 0..n-1 of a coordinate in [-1, 1]; outside values go to the edge bins."""
    n = n if isinstance(n, Column) else F.lit(n)
    raw = F.floor((col(c) + 1) / (F.lit(2.0) / n)).cast("long")
    return clip(raw, F.lit(0).cast("long"), n.cast("long") - 1)


def tile_index(x, y, n) -> Column:
    """Flat cell number row*n+col of an n x n grid."""
    n = n if isinstance(n, Column) else F.lit(n)
    return grid_bin(y, n) * n + grid_bin(x, n)


def voxel_index(x, y, z, n: int) -> Column:
    """Flat cell number (z*n+y)*n+x of an n x n x n grid."""
    bins = [clip(F.floor((col(c) + 1) / 2 * n).cast("long"), F.lit(0).cast("long"), F.lit(n - 1).cast("long")) for c in (x, y, z)]
    return (bins[2] * n + bins[1]) * n + bins[0]


def voxel_center(voxel, n: int) -> Column:
    """Centre coordinates of a voxel, the inverse of ``voxel_index``."""
    v = col(voxel)
    center = lambda b: (b + 0.5) * 2.0 / n - 1.0
    return F.struct(
        center(v % n).alias("x"),
        center(F.floor(v / n) % n).alias("y"),
        center(F.floor(v / (n * n))).alias("z"),
    )


def image_tile(cell, n, cell_px: int = 32, tile_px: int = 2048) -> Column:
    """Image tile of a grid cell; image rows count from the top, grid rows from the bottom."""
    n = n if isinstance(n, Column) else F.lit(n)
    per = F.lit(max(tile_px // cell_px, 1))  # cells along an edge of a tile
    cell = col(cell)
    row = n - 1 - F.floor(cell / n)
    return F.struct(
        F.floor((cell % n) / per).alias("tx"),
        F.floor(row / per).alias("ty"),
    )


# --- colour -----------------------------------------------------------------------------


def color_norm(v, lo, hi) -> Column:
    """Position of a value in [lo, hi] scaled to [0, 1] and clamped; null stays null."""
    lo, hi = col(lo).cast("double"), col(hi).cast("double")
    top = F.when(hi > lo, hi).otherwise(lo + 1)
    return clip((col(v).cast("double") - lo) / (top - lo), 0.0, 1.0)


def symlog(v) -> Column:
    return F.signum(col(v)) * F.log1p(F.abs(col(v)))


def symlog_scale(v, lo, hi) -> Column:
    """Symmetric-log position of a value in its extent, in [0, 1]."""
    a, b = symlog(lo), symlog(hi)
    return F.coalesce(F.try_divide(symlog(v) - a, b - a), F.lit(0.0))


# --- frames -----------------------------------------------------------------------------


def drop_binary_columns(df: DataFrame) -> DataFrame:
    """Leave out byte columns and image structs; they never reach the scan when unused."""

    def binary(t) -> bool:
        if isinstance(t, T.StructType):
            return any(isinstance(f.dataType, T.BinaryType) for f in t.fields)
        return isinstance(t, T.BinaryType)

    return df.select(*[f.name for f in df.schema.fields if not binary(f.dataType)])

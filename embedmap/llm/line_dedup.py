"""Boilerplate lines, told by how many distinct sites they occur on.

A HyperLogLog sketch of sites is kept per line hash; sketches merge as partial aggregates do, so a line
of a third of all rows never meets in one task. Lines whose estimate is well above or below the
threshold are decided by it, the others by an exact count of distinct sites. Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.session import store

SKETCH_LOG2 = 12  # relative standard error below 2 %; exact in effect up to some hundred sites
BAND = 2.0  # estimates within this factor of the threshold are counted exactly


def _lines(docs: DataFrame) -> DataFrame:
    """(id, text_key, site, pos, h1, h2): non-empty lines with two hashes of 64 bits."""
    lines = docs.select("id", "text_key", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.filter("line <> ''").select("id", "text_key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first): lines on at least ``min_sites`` distinct sites and the lowest (id, pos) that has them."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "pos")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LOG2)).alias("sites"), F.min(place).alias("first")
    )
    spread = store(spread.filter(F.col("sites") >= min_sites / BAND), "line-sites")
    sure = F.col("sites") >= min_sites * BAND
    near = spread.filter(~sure)
    # one row for each line and site before lines meet
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").filter("site IS NOT NULL")
    exact = exact.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    confirmed = near.join(exact.filter(F.col("exact") >= min_sites), ["h1", "h2"], "left_semi")
    return spread.filter(sure).union(confirmed).select("h1", "h2", "first")


def _on_own_texts(lines: DataFrame, bad: DataFrame, min_sites: int) -> DataFrame:
    """The lines of ``bad`` on ``min_sites`` sites if copies of one text count once, on the site of the lowest id."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "site")
    held = lines.filter("site IS NOT NULL").join(bad.select("h1", "h2"), ["h1", "h2"], "left_semi")
    # every copy of a text holds the line, so its lowest id is found without looking at whole texts
    home = held.groupBy("h1", "h2", "text_key").agg(F.min(place).alias("home"))
    sites = home.groupBy("h1", "h2", "home.site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return bad.join(sites.filter(F.col("exact") >= min_sites), ["h1", "h2"], "left_semi")


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = 8,
    keep_first: bool = True,
    fold_copies: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and columns n_lines and n_removed.

    Lines are what newlines separate; an empty line is never boilerplate. A line on at least
    ``min_sites`` distinct sites (a null site is none) goes everywhere but, with ``keep_first``, at its first place: the
    lowest (id, line number), null ids last. With ``fold_copies`` the rows
    of equal text count as one, on the site of the lowest id, so a copied page does not make boilerplate of its lines. Rows repeated with id and text keep or lose the same
    lines. A null text stays null, with no lines; an empty text has one empty line. Other columns
    pass through; columns named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = lambda: F.xxhash64(text_col)
    slim = docs.select(F.col(id_col).alias("id"), key().alias("text_key"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    lines = _lines(slim)
    bad = store(boilerplate(lines, min_sites), "boilerplate")
    if fold_copies:
        bad = store(_on_own_texts(lines, bad, min_sites), "boilerplate-folded")
    hits = lines.join(bad, ["h1", "h2"])
    if keep_first:
        at_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))
        hits = hits.filter(~at_first)
    gone = hits.groupBy("id", "text_key").agg(F.collect_set("pos").alias("_gone"))
    right = gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "_gone")
    both = docs.join(right, docs[id_col].eqNullSafe(right["_id"]) & (key() == right["_key"]), "left")
    all_lines = F.split(F.col(text_col), "\n", -1)
    keep: Column = F.filter(all_lines, lambda _, i: ~F.array_contains(right["_gone"], i))
    kept = F.array_join(keep, "\n")
    hit = right["_gone"].isNotNull()
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    n_removed = F.when(hit, F.size(right["_gone"])).otherwise(0).cast("long")
    text = F.when(hit, kept).otherwise(F.col(text_col)).alias(text_col)
    return both.select(*[text if c == text_col else docs[c] for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))

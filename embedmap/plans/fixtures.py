"""Inputs the registered queries share, derived from the given tables, in Spark and in SQL.

Everything derives from whole tables: the map is two or three embedding dimensions scaled to
[-1, 1], the clustering is the label column with some rows made noise by another dimension, and
deleted rows are chosen by a third one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.functions.common import rounded
from embedmap.operators import cluster as C
from embedmap.operators import joins as J
from embedmap.operators import project as P

NOISE_CUT = 0.2  # dimension 6 above this makes a row noise
DELETE_CUT = 0.15  # dimension 5 above this makes a row deleted
SHIFT_CUT = 0.1  # dimension 7 above this moves a row in the second clustering
NEW_LABEL = 8  # rows with this label or a higher one arrived later


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(ls_index, vector, e, label) with ``e`` the vector in double precision."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ls_index"),
        F.col("embedding").alias("vector"),
        F.col("embedding").cast("array<double>").alias("e"),
        F.col("label"),
    )


def layout(spark: SparkSession, sf: str, dims: dict[str, int]) -> DataFrame:
    """Map (ls_index, axes) from some embedding dimensions, scaled per axis to [-1, 1]."""
    v = vectors(spark, sf)
    raw = v.select("ls_index", *[F.col("e")[d].alias(a) for a, d in dims.items()])
    return P.normalize_frame(raw, list(dims))


def first_map(spark: SparkSession, sf: str) -> DataFrame:
    return layout(spark, sf, {"x": 0, "y": 1, "z": 2})


def second_map(spark: SparkSession, sf: str) -> DataFrame:
    return layout(spark, sf, {"x": 2, "y": 3})


def raw_clusters(spark: SparkSession, sf: str) -> DataFrame:
    noise = F.col("e")[6] > NOISE_CUT
    return vectors(spark, sf).select("ls_index", F.when(noise, -1).otherwise(F.col("label")).alias("raw_cluster"))


def second_clusters(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.col("e")[7] > SHIFT_CUT
    return vectors(spark, sf).select(
        "ls_index", F.when(moved, 9 - F.col("label")).otherwise(F.col("label")).alias("cluster")
    )


def scope(spark: SparkSession, sf: str) -> DataFrame:
    """Map, clustering with the noise rule, labels, deleted flag and grid cells."""
    clusters = C.noise_to_unclustered(raw_clusters(spark, sf))
    labels = C.default_labels(clusters)
    gone = vectors(spark, sf).select("ls_index", (F.col("e")[5] > DELETE_CUT).alias("deleted"))
    joined = J.scope_join(first_map(spark, sf), clusters, labels).drop("deleted")
    return J.with_cells(joined.join(gone, "ls_index"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(ls_index, token_vectors, num_tokens): the 64-d vector cut in 8 tokens of 8 dimensions."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("e", i * 8 + 1, 8))
    return vectors(spark, sf).select(
        "ls_index", tokens.alias("token_vectors"), F.lit(8).alias("num_tokens")
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """(ls_index, top_indices, top_acts): the 4 largest dimensions, negatives cut to 0."""
    pairs = F.transform("e", lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
    top = F.slice(F.array_sort(pairs), 1, 4)
    return vectors(spark, sf).select(
        "ls_index",
        F.transform(top, lambda p: p["i"]).alias("top_indices"),
        F.transform(top, lambda p: F.greatest(-p["neg"], F.lit(0.0))).alias("top_acts"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "ls_index")


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """(tag, ls_index) from the two label columns."""
    lab = table(spark, sf, "labels")
    named = F.array(
        F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")
    )
    return lab.select(F.explode(F.filter(named, lambda t: t.isNotNull())).alias("tag"), F.col("doc_id").alias("ls_index"))


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named columns for comparison."""
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


# --- the same in SQL ----------------------------------------------------------------------

VECTORS_SQL = """
v AS (SELECT vec_id AS ls_index, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""

MAP_SQL = VECTORS_SQL + """,
bnd AS (SELECT min(e[1]) a0, max(e[1]) a1, min(e[2]) b0, max(e[2]) b1,
               min(e[3]) c0, max(e[3]) c1, min(e[4]) d0, max(e[4]) d1 FROM v),
map1 AS (SELECT ls_index, 2*(e[1]-a0)/(a1-a0)-1 AS x, 2*(e[2]-b0)/(b1-b0)-1 AS y,
                2*(e[3]-c0)/(c1-c0)-1 AS z FROM v, bnd),
map2 AS (SELECT ls_index, 2*(e[3]-c0)/(c1-c0)-1 AS x, 2*(e[4]-d0)/(d1-d0)-1 AS y FROM v, bnd)"""

SCOPE_SQL = MAP_SQL + f""",
raw AS (SELECT ls_index, CASE WHEN e[7] > {NOISE_CUT} THEN -1 ELSE label END AS raw_cluster,
               e[6] > {DELETE_CUT} AS deleted,
               CASE WHEN e[8] > {SHIFT_CUT} THEN 9 - label ELSE label END AS cluster2 FROM v),
clu AS (SELECT *, CASE WHEN raw_cluster = -1
               THEN (SELECT coalesce(max(raw_cluster), -1) + 1 FROM raw WHERE raw_cluster <> -1)
               ELSE raw_cluster END AS cluster FROM raw),
scope AS (SELECT m.*, c.cluster, c.raw_cluster, c.deleted, c.cluster2,
  CASE WHEN raw_cluster = -1 THEN 'Unclustered' ELSE 'Cluster ' || cluster END AS label,
  least(greatest(CAST(floor((y+1)/(2.0/64)) AS BIGINT),0),63)*64
    + least(greatest(CAST(floor((x+1)/(2.0/64)) AS BIGINT),0),63) AS tile_index_64,
  least(greatest(CAST(floor((y+1)/(2.0/128)) AS BIGINT),0),127)*128
    + least(greatest(CAST(floor((x+1)/(2.0/128)) AS BIGINT),0),127) AS tile_index_128,
  (least(greatest(CAST(floor((z+1)/2*32) AS BIGINT),0),31)*32
    + least(greatest(CAST(floor((y+1)/2*32) AS BIGINT),0),31))*32
    + least(greatest(CAST(floor((x+1)/2*32) AS BIGINT),0),31) AS voxel_index_32
  FROM map1 m JOIN clu c USING (ls_index))"""

TOKENS_SQL = VECTORS_SQL + """,
tok AS (SELECT ls_index, p AS token_pos, list_slice(e, p*8+1, p*8+8) AS t
        FROM v, (SELECT unnest(range(8)) AS p))"""

FEATURES_SQL = VECTORS_SQL + """,
dims AS (SELECT ls_index, d AS feature_id, e[d+1] AS val FROM v, (SELECT unnest(range(64)) AS d)),
feat AS (SELECT ls_index, feature_id, greatest(val, 0.0) AS act, rn FROM
  (SELECT *, row_number() OVER (PARTITION BY ls_index ORDER BY val DESC, feature_id) AS rn FROM dims)
  WHERE rn <= 4)"""

TAGS_SQL = """
tags AS (SELECT 'good' AS tag, doc_id AS ls_index FROM labels WHERE quality = 1
         UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1)"""


def with_scope(body: str) -> str:
    return f"WITH {SCOPE_SQL} {body}"


def with_vectors(body: str) -> str:
    return f"WITH {VECTORS_SQL} {body}"


def with_map(body: str) -> str:
    return f"WITH {MAP_SQL} {body}"


def with_tokens(body: str) -> str:
    return f"WITH {TOKENS_SQL} {body}"


def with_features(body: str) -> str:
    return f"WITH {FEATURES_SQL} {body}"


def with_tags(body: str) -> str:
    return f"WITH {TAGS_SQL} {body}"

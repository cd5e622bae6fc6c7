"""Registered queries for vector search, array functions and sparse features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from embedmap.functions import vectors as V
from embedmap.operators import features as FE
from embedmap.operators import knn as K
from embedmap.operators import quantized as PQ
from embedmap.operators import search as SR
from embedmap.operators import sets as SE
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_features, with_map, with_tokens, with_vectors
from embedmap.plans.registry import query
from embedmap.session import store


def _vec(spark, sf):
    return X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))


def _first(spark, sf):
    """The query vector: that of row 0."""
    return _vec(spark, sf).filter("ls_index = 0").first()["vector"]


def _asks(spark, sf):
    """Many query vectors: rows whose id is also a benchmark item's."""
    items = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("ls_index"))
    return _vec(spark, sf).join(items, "ls_index", "left_semi").withColumnRenamed("ls_index", "query")


Q0 = "q AS (SELECT e AS q FROM v WHERE ls_index = 0)"
DIST = "1 - list_cosine_similarity(e, q)"

# --- array functions ----------------------------------------------------------------------


@query(
    "fn2_l2_normalize",
    with_vectors("""SELECT ls_index, round(e[1]*3/n,6)+0.0 AS first, round(e[64]*3/n,6)+0.0 AS last FROM
       (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x*3*x*3))) AS n FROM v)"""),
)
def fn2(spark, sf):
    v = V.l2_normalize(F.transform("vector", lambda x: x * 3))
    return r6(_vec(spark, sf).withColumn("u", v).select("ls_index", F.col("u")[0].alias("first"), F.col("u")[63].alias("last")), "first", "last")


@query(
    "fn3_truncate_dims",
    with_vectors("""SELECT ls_index, round(e[1]/n,6)+0.0 AS first, round(e[16]/n,6)+0.0 AS last, 16 AS dim FROM
       (SELECT *, sqrt(list_sum(list_transform(e[1:16], lambda x: x*x))) AS n FROM v)"""),
)
def fn3(spark, sf):
    t = _vec(spark, sf).withColumn("t", V.truncate_dims("vector", 16))
    return r6(t.select("ls_index", F.col("t")[0].alias("first"), F.col("t")[15].alias("last"), F.size("t").alias("dim")), "first", "last")


MEAN = """mv AS (SELECT ls_index, list_transform(range(1, 9), lambda d: (e[d]+e[d+8]+e[d+16]+e[d+24]+e[d+32]+e[d+40]+e[d+48]+e[d+56])/8) AS m FROM v)"""


@query(
    "fn4_mean_vector",
    f"""WITH {X.VECTORS_SQL}, {MEAN} SELECT ls_index, d AS dim, round(m[d+1]/(sqrt(list_sum(list_transform(m, lambda x: x*x)))+1e-10),6)+0.0 AS val
        FROM mv, (SELECT CAST(unnest(range(8)) AS INT) AS d)""",
)
def fn4(spark, sf):
    m = X.token_vectors(spark, sf).select("ls_index", F.posexplode(V.mean_vector("token_vectors")).alias("dim", "val"))
    return r6(m, "val")


@query(
    "fn5_truncate_token_vectors",
    with_tokens("""SELECT ls_index, token_pos, round(t[1]/(n+1e-10),6)+0.0 AS first, round(t[4]/(n+1e-10),6)+0.0 AS last FROM
       (SELECT ls_index, CAST(token_pos AS INT) AS token_pos, t, sqrt(list_sum(list_transform(t[1:4], lambda x: x*x))) AS n FROM tok)"""),
)
def fn5(spark, sf):
    cut = X.token_vectors(spark, sf).select("ls_index", F.posexplode(V.truncate_token_vectors("token_vectors", 4)).alias("token_pos", "t"))
    return r6(cut.select("ls_index", "token_pos", F.col("t")[0].alias("first"), F.col("t")[3].alias("last")), "first", "last")


# --- search -------------------------------------------------------------------------------


@query(
    "vec1_nn_search",
    f"""WITH {X.VECTORS_SQL}, {Q0} SELECT ls_index, round(d, 6)+0.0 AS distance FROM (SELECT ls_index, {DIST} AS d FROM v, q)
        ORDER BY d, ls_index LIMIT 150""",
)
def vec1(spark, sf):
    return r6(SR.nn_search(_vec(spark, sf), _first(spark, sf), 150), "distance")


@query(
    "vec2_nn_search_scoped",
    f"""WITH {X.SCOPE_SQL}, {Q0} SELECT ls_index, round(d, 6)+0.0 AS distance FROM
        (SELECT ls_index, {DIST} AS d FROM v JOIN scope USING (ls_index), q WHERE NOT deleted) ORDER BY d, ls_index LIMIT 100""",
)
def vec2(spark, sf):
    live = X.scope(spark, sf).filter("NOT deleted")
    return r6(SR.nn_search(_vec(spark, sf), _first(spark, sf), 100, scope=live), "distance")


@query(
    "vec3_nn_search_live",
    f"""WITH {X.SCOPE_SQL}, {Q0} SELECT ls_index, round(d, 6)+0.0 AS distance FROM (
        SELECT ls_index, d FROM (SELECT ls_index, {DIST} AS d FROM v, q ORDER BY d, ls_index LIMIT 150)
        JOIN scope USING (ls_index) WHERE NOT deleted ORDER BY d, ls_index LIMIT 20)""",
)
def vec3(spark, sf):
    gone = X.scope(spark, sf).filter("deleted")
    return r6(SR.nn_search_live(_vec(spark, sf), _first(spark, sf), gone), "distance")


@query(
    "vec4_knn_join_cosine",
    with_vectors("""SELECT ls_index, neighbor, round(d,6)+0.0 AS distance, CAST(rn AS INT) AS rank FROM (SELECT a.ls_index, b.ls_index AS neighbor,
       1 - list_cosine_similarity(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.ls_index ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.ls_index) AS rn
       FROM v a, v b WHERE a.ls_index <> b.ls_index) WHERE rn <= 5"""),
)
def vec4(spark, sf):
    v = _vec(spark, sf)
    return r6(K.knn_join(v, v, 5, "cosine", include_self=False), "distance")


@query(
    "vec4_knn_join_map",
    with_map("""SELECT ls_index, neighbor, round(d,6)+0.0 AS distance, CAST(rn AS INT) AS rank FROM (SELECT a.ls_index, b.ls_index AS neighbor,
       sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, row_number() OVER (PARTITION BY a.ls_index
         ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.ls_index) AS rn FROM map1 a, map1 b) WHERE rn <= 10"""),
)
def vec4_map(spark, sf):
    at = X.first_map(spark, sf).select("ls_index", F.array("x", "y").alias("vector"))
    return r6(K.knn_join(at, at, 10), "distance")


@query(
    "vec5_neighbors_of",
    with_map("""SELECT a.ls_index, round(sqrt((a.x-p.x)**2+(a.y-p.y)**2),6)+0.0 AS distance FROM map1 a,
       (SELECT x, y FROM map1 WHERE ls_index = 7) p WHERE a.ls_index <> 7 ORDER BY sqrt((a.x-p.x)**2+(a.y-p.y)**2), a.ls_index LIMIT 10"""),
)
def vec5(spark, sf):
    return r6(SR.neighbors_of(X.first_map(spark, sf), 7, 10), "distance")


SCORES = """qt AS (SELECT token_pos AS qp, t AS q FROM tok WHERE ls_index = 0),
sims AS (SELECT ls_index, qp, max(list_dot_product(t, q) / ((sqrt(list_dot_product(t, t)) + 1e-10) * (sqrt(list_dot_product(q, q)) + 1e-10))) AS s FROM tok, qt GROUP BY ls_index, qp),
score AS (SELECT ls_index, sum(s) AS score FROM sims GROUP BY ls_index)"""


@query("vec6_maxsim", f"WITH {X.TOKENS_SQL}, {SCORES} SELECT ls_index, round(score, 6)+0.0 AS score FROM score")
def vec6(spark, sf):
    docs = X.token_vectors(spark, sf)
    q = docs.filter("ls_index = 0").first()["token_vectors"]
    return r6(SR.maxsim(q, docs), "score")


@query(
    "vec7_late_interaction_search",
    f"WITH {X.TOKENS_SQL}, {SCORES} SELECT ls_index, round(score, 6)+0.0 AS score FROM score ORDER BY score.score DESC, ls_index LIMIT 50",
)
def vec7(spark, sf):
    docs = X.token_vectors(spark, sf)
    means = docs.select("ls_index", V.mean_vector("token_vectors").alias("vector"))
    q = docs.filter("ls_index = 0").first()["token_vectors"]
    return r6(SR.late_interaction_search(q, means, docs), "score")


BATCH = """found AS (SELECT query, ls_index, d, rn FROM (SELECT a.ls_index AS query, b.ls_index, 1 - list_cosine_similarity(a.e, b.e) AS d,
  row_number() OVER (PARTITION BY a.ls_index ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.ls_index) AS rn
  FROM v a JOIN benchmark ON item_id = a.ls_index, v b) WHERE rn <= 10)"""


@query("vec8_batch_search", f"WITH {X.VECTORS_SQL}, {BATCH} SELECT query, ls_index, round(d,6)+0.0 AS distance, CAST(rn AS INT) AS rank FROM found")
def vec8(spark, sf):
    return r6(SR.batch_search(_asks(spark, sf), _vec(spark, sf), 10), "distance")


@query("vec9_ivf_search", f"WITH {X.VECTORS_SQL}, {BATCH} SELECT query, ls_index, round(d,6)+0.0 AS distance, CAST(rn AS INT) AS rank FROM found")
def vec9(spark, sf):
    # with every cell probed an index must give the exact answer
    index = SR.ivf_build(_vec(spark, sf), nlist=16)
    return r6(SR.ivf_search(_asks(spark, sf), index, 10, nprobe=16), "distance")


def _pq(spark, sf, v):
    """Codes of 16 bytes in 16 cells, of which a query probes 12."""
    return PQ.pq_search(_asks(spark, sf), PQ.pq_build(v, nlist=16), 10, nprobe=12)


@query("vec9_pq_search")
def vec9_pq(spark, sf):
    return r6(_pq(spark, sf, _vec(spark, sf)), "distance")


# every query has its 10 rows, and at least 0.9 of the rows are no farther than the exact tenth
@query(
    "vec9_pq_recall",
    f"WITH {X.VECTORS_SQL}, {BATCH} SELECT count(*) AS entries, round(avg(d), 5)+0.0 AS exact_mean, true AS found FROM found",
)
def vec9_pq_recall(spark, sf):
    v = store(_vec(spark, sf), "vectors")
    exact = store(SR.batch_search(_asks(spark, sf), v, 10), "exact")
    ends = exact.groupBy("query").agg(F.max("distance").alias("end"))
    hits = _pq(spark, sf, v).join(ends, "query").agg(F.count_if(F.col("distance") <= F.col("end") + 1e-6).alias("hits"), F.count("*").alias("rows"))
    whole = exact.agg(F.count("*").alias("entries"), (F.round(F.avg("distance"), 5) + 0.0).alias("exact_mean"))
    # one row each
    both = (F.col("rows") == F.col("entries")) & (F.col("hits") >= 0.9 * F.col("entries"))
    return whole.join(hits).select("entries", "exact_mean", both.alias("found"))


@query(
    "vec10_search_quality",
    f"""WITH {X.VECTORS_SQL}, {BATCH} SELECT query, count(*) FILTER (WHERE a.label = b.label) AS hits, count(*) AS "of",
        round(count(*) FILTER (WHERE a.label = b.label) / count(*), 6)+0.0 AS share
        FROM found JOIN v a ON a.ls_index = query JOIN v b ON b.ls_index = found.ls_index WHERE rn <= 5 GROUP BY query""",
)
def vec10(spark, sf):
    topics = X.vectors(spark, sf).select("ls_index", F.col("label").alias("topic"))
    found = SR.batch_search(_asks(spark, sf), _vec(spark, sf), 10)
    return r6(SR.search_quality(found, topics.withColumnRenamed("ls_index", "query"), topics, 5), "share")


@query(
    "vec11_closest_on_map",
    with_map("""SELECT ls_index, round(sqrt((x-0.05)**2+(y+0.1)**2),6)+0.0 AS distance FROM map1
       WHERE x BETWEEN 0.0 AND 0.1 AND y BETWEEN -0.15 AND -0.05 ORDER BY sqrt((x-0.05)**2+(y+0.1)**2), ls_index LIMIT 10"""),
)
def vec11(spark, sf):
    return r6(SR.closest_on_map(X.first_map(spark, sf), 0.05, -0.1, 10), "distance")


@query(
    "set2_candidate_union",
    f"""WITH {X.VECTORS_SQL}, {Q0}, p AS (SELECT e AS q FROM v WHERE ls_index = 1)
    SELECT ls_index FROM (SELECT ls_index FROM v, q ORDER BY {DIST}, ls_index LIMIT 50)
    UNION SELECT ls_index FROM (SELECT ls_index FROM v, p AS q ORDER BY {DIST}, ls_index LIMIT 50)""",
)
def set2(spark, sf):
    v = _vec(spark, sf)
    other = v.filter("ls_index = 1").first()["vector"]
    return SE.candidate_union(SR.nn_search(v, _first(spark, sf), 50), SR.nn_search(v, other, 50))


NEAR = """{n} AS (SELECT i, j FROM (SELECT p.ls_index AS i, q.ls_index AS j, row_number() OVER (PARTITION BY p.ls_index
   ORDER BY sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)), q.ls_index) AS rn FROM {m} p, {m} q) WHERE rn <= 5)"""


@query(
    "set4_neighbor_intersection",
    f"""WITH {X.MAP_SQL}, {NEAR.format(n='n1', m='map1')}, {NEAR.format(n='n2', m='map2')}
    SELECT n1.i AS ls_index, count(n2.j) AS n_common, 10 - count(n2.j) AS n_union FROM n1 LEFT JOIN n2 ON n1.i = n2.i AND n1.j = n2.j GROUP BY 1""",
)
def set4(spark, sf):
    near = lambda m: K.knn_join(m, m, 5).select("ls_index", "neighbor")
    at = lambda m: m.select("ls_index", F.array("x", "y").alias("vector"))
    return SE.neighbor_overlap(near(at(X.first_map(spark, sf))), near(at(X.second_map(spark, sf))))


# --- sparse features ----------------------------------------------------------------------

STATS = """stats AS (SELECT CAST(d AS INT) AS feature_id, greatest(coalesce(max(act), 0), 0) AS max_activation,
  count(*) FILTER (WHERE act > 0) AS n, coalesce(sum(act), 0) / greatest(count(*) FILTER (WHERE act > 0), 1) AS avg_activation
  FROM (SELECT unnest(range(64)) AS d) LEFT JOIN feat ON feature_id = d GROUP BY d)"""


@query(
    "feat1_feature_stats",
    f"""WITH {X.FEATURES_SQL}, {STATS} SELECT feature_id, round(max_activation,6)+0.0 AS max_activation, n AS "count",
        round(avg_activation,6)+0.0 AS avg_activation FROM stats""",
)
def feat1(spark, sf):
    return r6(FE.feature_stats(X.features(spark, sf), 64), "max_activation", "avg_activation")


@query(
    "feat1_alive_features",
    f"""WITH {X.FEATURES_SQL}, {STATS} SELECT count(*) FILTER (WHERE max_activation > 0) AS alive,
        count(*) FILTER (WHERE max_activation <= 0) AS dead FROM stats""",
)
def feat1_alive(spark, sf):
    return FE.alive_features(FE.feature_stats(X.features(spark, sf), 64))


@query("feat2_feature_search", with_features("SELECT ls_index, round(act,6)+0.0 AS act FROM feat WHERE feature_id = 3 AND act > 0.1"))
def feat2(spark, sf):
    return r6(FE.feature_search(X.features(spark, sf), 3, 0.1), "act")


@query(
    "feat3_encode_topk",
    with_vectors("""SELECT ls_index, feature_id, round(act,6)+0.0 AS act FROM (SELECT a.ls_index, CAST(rank_w - 1 AS INT) AS feature_id, greatest(list_sum(list_transform(list_zip(a.e, b.e),
         lambda p: p[1]*p[2])), 0.0) AS act, row_number() OVER (PARTITION BY a.ls_index ORDER BY greatest(list_sum(list_transform(list_zip(a.e, b.e),
         lambda p: p[1]*p[2])), 0.0) DESC, rank_w) AS rn
         FROM v a, (SELECT e, row_number() OVER (ORDER BY ls_index) AS rank_w FROM v JOIN benchmark ON item_id = ls_index) b) WHERE rn <= 4"""),
)
def feat3(spark, sf):
    # the weights are the vectors of the benchmark items, one feature each
    w = np.array([r["vector"] for r in _asks(spark, sf).orderBy("query").collect()]).T
    coded = FE.encode_topk(_vec(spark, sf), w, k=4)
    return r6(FE.long_features(coded), "act")


@query(
    "feat3_token_features",
    with_tokens("""SELECT ls_index, feature_id, round(act,6)+0.0 AS act, CAST(rn AS INT) AS rank FROM (SELECT ls_index, feature_id, max(act) AS act,
         row_number() OVER (PARTITION BY ls_index ORDER BY max(act) DESC, feature_id) AS rn FROM
         (SELECT ls_index, CAST(d AS INT) AS feature_id, greatest(CASE WHEN d < 8 THEN t[d+1] ELSE -t[d-7] END - 0.05, 0.0) AS act
          FROM tok, (SELECT unnest(range(16)) AS d)) GROUP BY 1, 2) WHERE rn <= 5"""),
)
def feat3_tokens(spark, sf):
    # one feature for either direction of each dimension; tokens are encoded, then rolled up by document
    tokens = X.token_vectors(spark, sf).select("ls_index", F.explode("token_vectors").alias("vector"))
    both = np.concatenate([np.eye(8), -np.eye(8)], axis=1)
    return r6(FE.max_over_tokens(FE.encode_topk(tokens, both, np.full(16, -0.05), k=16), 5), "act")


@query(
    "feat4_max_over_tokens",
    with_tokens("""SELECT ls_index, feature_id, round(act,6)+0.0 AS act, CAST(rn AS INT) AS rank FROM (SELECT ls_index, feature_id, max(act) AS act,
         row_number() OVER (PARTITION BY ls_index ORDER BY max(act) DESC, feature_id) AS rn FROM
         (SELECT ls_index, CAST(d AS INT) AS feature_id, greatest(t[d+1], 0.0) AS act FROM tok, (SELECT unnest(range(8)) AS d)) GROUP BY 1, 2) WHERE rn <= 4"""),
)
def feat4(spark, sf):
    tokens = X.token_vectors(spark, sf).select("ls_index", F.explode("token_vectors").alias("t"))
    acts = tokens.select(
        "ls_index",
        F.sequence(F.lit(0), F.lit(7)).alias("top_indices"),
        F.transform("t", lambda x: F.greatest(x, F.lit(0.0))).alias("top_acts"),
    )
    return r6(FE.max_over_tokens(acts, 4), "act")


@query("feat5_sparse_matrix", with_features("SELECT ls_index, CAST(feature_id AS INT) AS feature_id, round(act,6)+0.0 AS act FROM feat"))
def feat5(spark, sf):
    return r6(FE.long_features(X.features(spark, sf)), "act")


@query(
    "feat5_sparse_vector",
    f"""WITH {X.FEATURES_SQL} SELECT a.ls_index, CAST(d AS INT) AS feature_id, round(coalesce(act, 0),6)+0.0 AS act
        FROM (SELECT ls_index, unnest(range(64)) AS d FROM v) a LEFT JOIN feat f ON f.ls_index = a.ls_index AND f.feature_id = d""",
)
def feat5_vector(spark, sf):
    f = X.features(spark, sf).select("ls_index", FE.sparse_vector(64).alias("v"))
    return r6(f.select("ls_index", F.posexplode(FE.dense_vector("v")).alias("feature_id", "act")), "act")


@query(
    "fn16_sae_norm",
    f"""WITH {X.FEATURES_SQL}, {STATS} SELECT ls_index, CAST(f.feature_id AS INT) AS feature_id, round(coalesce(act/nullif(max_activation,0),0),6)+0.0 AS share
        FROM feat f JOIN stats s ON f.feature_id = s.feature_id""",
)
def fn16(spark, sf):
    f = X.features(spark, sf)
    return r6(FE.sae_norm(f, FE.feature_stats(f, 64)), "share")



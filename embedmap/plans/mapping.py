"""Registered queries for maps, clusterings and their evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from embedmap.functions.vectors import l2_normalize
from embedmap.operators import aligned as AL
from embedmap.operators import cluster as C
from embedmap.operators import evaluate as E
from embedmap.operators import farfield as FF
from embedmap.operators import layout as LY
from embedmap.operators import project as P
from embedmap.operators import sparse_svd as SV
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_features, with_map, with_scope, with_vectors
from embedmap.plans.registry import query
from embedmap.session import store

# --- projection and frames ----------------------------------------------------------------


def _project(spark, sf, components):
    return P.project(X.vectors(spark, sf), "e", components)


for _k in (1, 2, 3):
    query(f"prj1_project_{_k}d")(partial(_project, components=_k))


@query("prj2_graph_layout")
def prj2(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))
    return LY.graph_layout(v, P.project(v))


@query("prj3_project_features")
def prj3(spark, sf):
    return P.project_features(X.features(spark, sf), 64, 256)


def _frame(df, *axes):
    """Per axis the number of rows, the range, and the correlation with the next axis."""
    after = [*axes[1:], axes[0]]
    each = [
        F.struct(F.lit(a).alias("axis"), F.col("n").alias("n"), F.round(F.col(f"lo_{a}"), 6).alias("lo"), F.round(F.col(f"hi_{a}"), 6).alias("hi"), (F.abs(F.col(f"c_{a}")) < 1e-6).alias("apart"))
        for a in axes
    ]
    aggs = [x for a, b in zip(axes, after, strict=True) for x in (F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}"), F.corr(a, b).alias(f"c_{a}"))]
    return df.agg(F.count("*").alias("n"), *aggs).select(F.explode(F.array(*each)).alias("s")).select("s.*")


def _frame_sql(count, apart):
    return f"SELECT axis, n, -1.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, {apart} AS apart FROM (SELECT unnest(['x', 'y']) AS axis), ({count})"


# principal axes do not correlate, and every row has a place in the frame
@query("prj1_frame", _frame_sql("SELECT count(*) AS n FROM embeddings", "true"))
def prj1_frame(spark, sf):
    return _frame(P.project(X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))), "x", "y")


@query(
    "prj1_explained",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    m AS (SELECT i, avg(x) AS mean, var_pop(x) AS var FROM (SELECT generate_subscripts(e, 1) AS i, unnest(e) AS x FROM u) GROUP BY i)
    SELECT count(*) AS dims, round(sum(var), 6)+0.0 AS total, true AS no_dimension_has_more FROM m""",
)
def prj1_explained(spark, sf):
    # the first axis must hold at least as much variance as any one dimension does
    v = X.vectors(spark, sf).select("ls_index", l2_normalize("e").alias("u"))
    each = v.select("ls_index", F.posexplode("u").alias("i", "x"))
    dims = each.groupBy("i").agg(F.var_pop("x").alias("var")).agg(F.count("*").alias("dims"), F.sum("var").alias("total"), F.max("var").alias("most"))
    share = float(P.fit_pca(v, "u", 1).explainedVariance[0])
    more = F.col("total") * share >= F.col("most") - 1e-9
    return dims.select("dims", F.round("total", 6).alias("total"), more.alias("no_dimension_has_more"))


@query("prj2_frame", _frame_sql("SELECT count(*) AS n FROM embeddings", "NULL::BOOLEAN"))
def prj2_frame(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))
    # axes of a graph layout may correlate
    return _frame(LY.graph_layout(v, P.project(v)), "x", "y").withColumn("apart", F.lit(None).cast("boolean"))


@query("prj3_frame", with_features(_frame_sql("SELECT count(DISTINCT feature_id) AS n FROM feat WHERE act > 0", "true")))
def prj3_frame(spark, sf):
    return _frame(P.project_features(X.features(spark, sf), 64, 256), "x", "y")


@query("prj3_sparse_map")
def prj3_sparse(spark, sf):
    return SV.sparse_feature_map(X.features(spark, sf), 64)


# leading vectors are orthonormal, keep their direction under the covariance, and hold no more than the whole
@query(
    "prj3_sparse_vectors",
    with_features("""SELECT count(DISTINCT feature_id) AS features, CAST(count(*) AS BIGINT) AS entries, round(sum(act*act), 4)+0.0 AS weight, true AS unit, true AS steady
        FROM (SELECT feature_id, act / sqrt(sum(act*act) OVER (PARTITION BY feature_id)) AS act FROM feat WHERE act > 0)"""),
)
def prj3_vectors(spark, sf):
    entries = SV.unit_entries(X.features(spark, sf), 64)
    vectors, values = SV.sparse_svd(entries, 2)
    v = store(vectors.select("feature_id", *[F.col("q")[j].alias(f"q{j}") for j in range(2)]), "vectors")
    across = entries.join(v, "feature_id").groupBy("ls_index").agg(*[F.sum(F.col("act") * F.col(f"q{j}")).alias(f"b{j}") for j in range(2)])
    back = entries.join(across, "ls_index").groupBy("feature_id").agg(*[F.sum(F.col("act") * F.col(f"b{j}")).alias(f"c{j}") for j in range(2)])
    moved = [F.max(F.abs(F.col(f"c{j}") - F.lit(values[j] ** 2) * F.col(f"q{j}"))) <= 1e-2 * values[j] ** 2 for j in range(2)]
    norms = [F.abs(F.sum(F.col(f"q{j}") ** 2) - 1) < 1e-6 for j in range(2)] + [F.abs(F.sum(F.col("q0") * F.col("q1"))) < 1e-6]
    checks = back.join(v, "feature_id").agg((norms[0] & norms[1] & norms[2]).alias("unit"), (moved[0] & moved[1]).alias("steady"))
    whole = entries.agg(F.count_distinct("feature_id").alias("features"), F.count("*").alias("entries"), (F.round(F.sum(F.col("act") ** 2), 4) + 0.0).alias("weight"))
    return whole.join(checks)


@query("prj4_normalize_frame", with_map("SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM map1"))
def prj4(spark, sf):
    return r6(X.first_map(spark, sf), "x", "y", "z")


@query(
    "prj5_apply_frame",
    with_vectors("SELECT ls_index, round(2*(e[1]+0.2)/0.5-1,6)+0.0 AS x, round(2*(e[2]+0.1)/0.3-1,6)+0.0 AS y FROM v"),
)
def prj5(spark, sf):
    raw = X.vectors(spark, sf).select("ls_index", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))
    return r6(P.apply_frame(raw, ["x", "y"], {"x_min": -0.2, "x_max": 0.3, "y_min": -0.1, "y_max": 0.2}), "x", "y")


# the best of a rotation and a reflection, in closed form
FIT = """pair AS (SELECT a.ls_index, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy FROM map1 a JOIN map2 b USING (ls_index)),
m AS (SELECT count(*) AS n, covar_pop(dx,sx) a, covar_pop(dx,sy) b, covar_pop(dy,sx) c, covar_pop(dy,sy) d,
        avg(sx) ax, avg(sy) ay, avg(dx) bx, avg(dy) by_, var_pop(sx)+var_pop(sy) AS vv FROM pair),
g AS (SELECT *, sqrt((a+d)**2+(c-b)**2) AS g1, sqrt((a-d)**2+(c+b)**2) AS g2 FROM m),
r AS (SELECT *, greatest(g1,g2)/vv AS s,
        CASE WHEN g1>=g2 THEN (a+d)/g1 ELSE (a-d)/g2 END AS r11, CASE WHEN g1>=g2 THEN (b-c)/g1 ELSE (b+c)/g2 END AS r12,
        CASE WHEN g1>=g2 THEN (c-b)/g1 ELSE (b+c)/g2 END AS r21, CASE WHEN g1>=g2 THEN (a+d)/g1 ELSE (d-a)/g2 END AS r22 FROM g),
fit AS (SELECT *, bx - s*(r11*ax+r12*ay) AS tx, by_ - s*(r21*ax+r22*ay) AS ty FROM r)"""


@query(
    "prj6_fit_similarity",
    f"""WITH {X.MAP_SQL}, {FIT} SELECT round(s,6)+0.0 AS c, round(r11,6)+0.0 AS r11, round(r12,6)+0.0 AS r12,
        round(r21,6)+0.0 AS r21, round(r22,6)+0.0 AS r22, round(tx,6)+0.0 AS tx, round(ty,6)+0.0 AS ty, n FROM fit""",
)
def prj6(spark, sf):
    from embedmap.operators.joins import shared_prefix

    pairs = shared_prefix([X.first_map(spark, sf), X.second_map(spark, sf)], ["x", "y"])
    pairs = pairs.withColumnsRenamed({"a_x": "sx", "a_y": "sy", "b_x": "dx", "b_y": "dy"})
    return r6(P.fit_similarity(pairs), "c", "r11", "r12", "r21", "r22", "tx", "ty")


@query(
    "prj7_apply_similarity",
    with_map("SELECT ls_index, round(1.5*(0.6*x-0.8*y)+0.25,6)+0.0 AS x, round(1.5*(0.8*x+0.6*y)-1,6)+0.0 AS y FROM map1"),
)
def prj7(spark, sf):
    m = X.first_map(spark, sf).select("ls_index", "x", "y")
    # a planted transform, one row
    fit = m.agg(*[F.lit(v).alias(k) for k, v in dict(c=1.5, r11=0.6, r12=-0.8, r21=0.8, r22=0.6, tx=0.25, ty=-1.0).items()])
    return r6(P.apply_similarity(m, fit), "x", "y")


@query(
    "prj8_register_layout",
    f"""WITH {X.MAP_SQL}, {FIT} SELECT ls_index, round(s*(r11*x+r12*y)+tx,6)+0.0 AS x, round(s*(r21*x+r22*y)+ty,6)+0.0 AS y
        FROM map1, fit""",
)
def prj8(spark, sf):
    m = X.first_map(spark, sf).select("ls_index", "x", "y")
    return r6(P.register_layout(m, X.second_map(spark, sf)), "x", "y")


MOVED = "round(s*(r11*x+r12*y)+tx,6)+0.0 AS x, round(s*(r21*x+r22*y)+ty,6)+0.0 AS y"


@query(
    "prj9_align_layouts",
    f"""WITH {X.MAP_SQL}, {FIT} SELECT 1 AS "window", ls_index, {MOVED} FROM map1, fit
        UNION ALL SELECT 2, ls_index, {MOVED} FROM map1, fit
        UNION ALL SELECT 0, ls_index, round(x,6)+0.0, round(y,6)+0.0 FROM map2""",
)
def prj9(spark, sf):
    # the third window is the second one turned, scaled and moved: along the chain it must land on it
    one = X.first_map(spark, sf).select("ls_index", "x", "y")
    turned = one.select("ls_index", (F.lit(3.0) + 0.5 * F.col("y")).alias("x"), (F.lit(-1.0) - 0.5 * F.col("x")).alias("y"))
    return r6(P.align_layouts([X.second_map(spark, sf), one, turned]), "x", "y")


# three windows of half of the dimensions, each overlapping the one before; every row has a place in each
@query(
    "prj9_joint_layouts",
    """SELECT w::INT AS "window", (SELECT count(*) FROM embeddings) AS rows, true AS inside FROM range(3) t(w)""",
)
def prj9_joint(spark, sf):
    v = X.vectors(spark, sf)
    parts = [v.select("ls_index", F.slice("e", at, 32).alias("vector")) for at in (1, 17, 33)]
    placed = AL.aligned_layouts(parts)
    inside = F.bool_and((F.abs("x") <= 1 + 1e-9) & (F.abs("y") <= 1 + 1e-9))
    return placed.groupBy("window").agg(F.count("*").alias("rows"), inside.alias("inside"))


PLACE_SQL = f"""near AS (SELECT n.ls_index, o.ls_index AS neighbor, list_cosine_similarity(n.e, o.e) AS sim,
    row_number() OVER (PARTITION BY n.ls_index ORDER BY 1 - list_cosine_similarity(n.e, o.e), o.ls_index) AS rn
    FROM v n, v o WHERE n.label >= {X.NEW_LABEL} AND o.label < {X.NEW_LABEL}),
placed AS (SELECT r.ls_index, sum(greatest(sim,1e-6)*x)/sum(greatest(sim,1e-6)) AS x,
    sum(greatest(sim,1e-6)*y)/sum(greatest(sim,1e-6)) AS y
    FROM near r JOIN map1 m ON m.ls_index = r.neighbor WHERE rn <= 15 GROUP BY r.ls_index)"""


@query(
    "prj10_place_new_rows",
    f"""WITH {X.MAP_SQL}, {PLACE_SQL} SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y FROM placed
        UNION ALL SELECT ls_index, round(x,6)+0.0, round(y,6)+0.0 FROM map1 JOIN v USING (ls_index) WHERE label < {X.NEW_LABEL}""",
)
def prj10(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"), "label")
    old, new = v.filter(F.col("label") < X.NEW_LABEL), v.filter(F.col("label") >= X.NEW_LABEL)
    old_map = X.first_map(spark, sf).join(old, "ls_index", "left_semi").select("ls_index", "x", "y")
    return r6(P.place_new_rows(old_map, old.drop("label"), new.drop("label"), 15), "x", "y")


@query("prj11_project_tokens")
def prj11(spark, sf):
    from embedmap.operators.tokens import explode_token_vectors

    tokens = explode_token_vectors(X.token_vectors(spark, sf)).select(F.col("token_index").alias("ls_index"), "vector")
    return P.project(tokens, "vector")


@query("prj11_frame", _frame_sql("SELECT 8 * count(*) AS n FROM embeddings", "true"))
def prj11_frame(spark, sf):
    return _frame(prj11(spark, sf), "x", "y")


# --- clustering ---------------------------------------------------------------------------


@query("clu1_kmeans")
def clu1(spark, sf):
    return C.kmeans(X.first_map(spark, sf), 8)


@query("clu2_gmm")
def clu2(spark, sf):
    return C.gmm(X.first_map(spark, sf).drop("z"), 5)


def _numbering(found):
    """One row: all rows placed, in how many clusters, numbered from 0 by falling size."""
    sizes = found.groupBy("raw_cluster").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("raw_cluster", "n")))
    one = sizes.agg(order.alias("o"))
    falls = F.forall(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.get("o.n", i - 1) >= F.get("o.n", i))
    rows = F.aggregate("o.n", F.lit(0).cast("long"), lambda s, n: s + n)
    return one.select(rows.alias("n"), F.size("o").alias("clusters"), (F.array_min("o.raw_cluster") == 0).alias("from_zero"), falls.alias("by_size"))


@query("clu1_numbering", "SELECT count(*) AS n, CAST(8 AS INT) AS clusters, true AS from_zero, true AS by_size FROM embeddings")
def clu1_numbering(spark, sf):
    return _numbering(clu1(spark, sf))


@query("clu2_numbering", "SELECT count(*) AS n, CAST(5 AS INT) AS clusters, true AS from_zero, true AS by_size FROM embeddings")
def clu2_numbering(spark, sf):
    return _numbering(clu2(spark, sf))


@query(
    "clu3_density_clusters",
    f"""WITH RECURSIVE {X.MAP_SQL},
      e AS (SELECT a.ls_index AS a, b.ls_index AS b FROM map1 a, map1 b
            WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.06*0.06),
      core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4),
      link AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)),
      reach AS (SELECT a AS node, a AS root FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
      comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
      big AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS id FROM comp GROUP BY root HAVING count(*) >= 6)
      SELECT ls_index, CAST(coalesce(id, -1) AS INT) AS raw_cluster FROM map1 LEFT JOIN comp ON node = ls_index LEFT JOIN big USING (root)""",
)
def clu3(spark, sf):
    m = X.first_map(spark, sf).select("ls_index", "x", "y")
    return C.density_clusters(m, min_cluster_size=6, min_samples=4, eps=0.06)


@query(
    "clu4_graph_clusters",
    f"""WITH RECURSIVE {X.VECTORS_SQL},
      r AS (SELECT a.ls_index AS a, b.ls_index AS b, row_number() OVER (PARTITION BY a.ls_index
              ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.ls_index) AS rn FROM v a, v b WHERE a.ls_index <> b.ls_index),
      near AS (SELECT a, b FROM r WHERE rn <= 4),
      link AS (SELECT n.a, n.b FROM near n JOIN near m ON n.a = m.b AND n.b = m.a),
      reach AS (SELECT ls_index AS node, ls_index AS root FROM v UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
      comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
      big AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS id FROM comp GROUP BY root HAVING count(*) >= 5)
      SELECT ls_index, CAST(coalesce(id, -1) AS INT) AS raw_cluster FROM v JOIN comp ON node = ls_index LEFT JOIN big USING (root)""",
)
def clu4(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))
    return C.graph_clusters(v, k=4, min_cluster_size=5)


@query("clu5_column_clusters", "SELECT doc_id AS ls_index, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS raw_cluster FROM documents")
def clu5(spark, sf):
    return C.column_clusters(X.documents(spark, sf), "source")


@query("clu6_cluster_space", with_map("SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM map1"))
def clu6(spark, sf):
    _, space = C.cluster_space("density", "rows", X.first_map(spark, sf), X.vectors(spark, sf))
    return r6(space, "x", "y", "z")


@query("clu7_noise_to_unclustered", with_scope("SELECT ls_index, raw_cluster, cluster FROM scope"))
def clu7(spark, sf):
    return C.noise_to_unclustered(X.raw_clusters(spark, sf))


@query(
    "clu8_noise_to_nearest",
    with_scope("""SELECT ls_index, raw_cluster, cl AS cluster FROM (
       WITH c AS (SELECT raw_cluster AS id, avg(x) cx, avg(y) cy, avg(z) cz FROM scope WHERE raw_cluster <> -1 GROUP BY 1)
       SELECT ls_index, raw_cluster, raw_cluster AS cl FROM scope WHERE raw_cluster <> -1
       UNION ALL SELECT ls_index, -1, id FROM (SELECT ls_index, id, row_number() OVER (PARTITION BY ls_index
         ORDER BY (x-cx)**2+(y-cy)**2+(z-cz)**2, id) AS rn FROM scope, c WHERE raw_cluster = -1) WHERE rn = 1)"""),
)
def clu8(spark, sf):
    points = X.first_map(spark, sf).join(X.raw_clusters(spark, sf), "ls_index")
    return C.noise_to_nearest(points).select("ls_index", "raw_cluster", "cluster")


# a row is a hull vertex iff it starts an edge with every other point on its left
HULL = """pt AS (SELECT raw_cluster AS c, ls_index, x, y FROM scope WHERE raw_cluster >= 0),
edge AS (SELECT a.c, a.ls_index AS a, b.ls_index AS b FROM pt a JOIN pt b ON a.c = b.c AND a.ls_index <> b.ls_index
  WHERE NOT EXISTS (SELECT 1 FROM pt p WHERE p.c = a.c AND p.ls_index <> a.ls_index AND p.ls_index <> b.ls_index
    AND (b.x-a.x)*(p.y-a.y) - (b.y-a.y)*(p.x-a.x) <= 0))"""


@query("clu9_cluster_hulls", f"WITH {X.SCOPE_SQL}, {HULL} SELECT CAST(c AS INT) AS cluster, a AS ls_index FROM edge")
def clu9(spark, sf):
    points = X.first_map(spark, sf).join(X.raw_clusters(spark, sf), "ls_index")
    return C.cluster_hulls(points).select("cluster", "ls_index")


@query(
    "clu10_hull_points",
    f"""WITH {X.SCOPE_SQL}, {HULL}, h AS (SELECT c, a AS ls_index, x, y FROM edge JOIN scope ON ls_index = a WHERE NOT deleted)
    SELECT CAST(c AS INT) AS cluster, round(avg(x),6)+0.0 AS anchor_x, round(avg(y),6)+0.0 AS anchor_y,
      arg_max(ls_index, y) AS top_id, round(arg_max(x, y),6)+0.0 AS top_x, round(max(y),6)+0.0 AS top_y FROM h GROUP BY c""",
)
def clu10(spark, sf):
    s = X.scope(spark, sf)
    return r6(C.hull_anchors(C.hull_points(C.cluster_hulls(s), s)), "anchor_x", "anchor_y", "top_x", "top_y")


# --- evaluation ---------------------------------------------------------------------------


SILHOUETTE = """SELECT round(avg(CASE WHEN nown = 1 THEN 0 ELSE (b-a)/greatest(a,b) END), 4) AS silhouette, count(*) AS scored FROM (
       SELECT i, max(CASE WHEN ci = cj THEN k END) AS nown, max(CASE WHEN ci = cj THEN s/nullif(k-1,0) END) AS a,
         min(CASE WHEN ci <> cj THEN s/k END) AS b FROM (
         SELECT p.ls_index AS i, p.cluster AS ci, q.cluster AS cj, count(*) AS k,
           sum(sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)) AS s FROM scope p, scope q GROUP BY 1, 2, 3) GROUP BY i)"""


@query("eval1_silhouette", with_scope(SILHOUETTE))
def eval1(spark, sf):
    return E.silhouette(X.scope(spark, sf))


# the score by cell summaries lies within its tolerance of the exact one, here with the rounding of both
@query("eval1_silhouette_far", with_scope(f"SELECT scored, true AS near FROM ({SILHOUETTE})"))
def eval1_far(spark, sf):
    s = store(X.scope(spark, sf).select("ls_index", "cluster", "x", "y", "z"), "scope")
    exact = E.silhouette(s).withColumnsRenamed({"silhouette": "exact", "scored": "all"})
    # one row each
    gap = F.abs(F.col("silhouette") - F.col("exact"))
    return FF.silhouette_far(s).join(exact).select("scored", (gap <= 1e-3 + 1e-4).alias("near"))


@query(
    "eval2_calinski_harabasz",
    with_scope("""SELECT round((sum(n*((cx-gx)**2+(cy-gy)**2+(cz-gz)**2))/(count(*)-1)) / (sum(w)/(sum(n)-count(*))), 2) AS calinski_harabasz FROM
       (SELECT cluster, count(*) n, avg(x) cx, avg(y) cy, avg(z) cz, count(*)*(var_pop(x)+var_pop(y)+var_pop(z)) w FROM scope GROUP BY cluster),
       (SELECT avg(x) gx, avg(y) gy, avg(z) gz FROM scope)"""),
)
def eval2(spark, sf):
    return E.calinski_harabasz(X.scope(spark, sf))


@query(
    "eval3_davies_bouldin",
    with_scope("""SELECT round(avg(r),4) AS davies_bouldin FROM (
       WITH c AS (SELECT cluster, avg(x) cx, avg(y) cy, avg(z) cz FROM scope GROUP BY cluster),
       s AS (SELECT cluster, cx, cy, cz, avg(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)) AS s FROM scope JOIN c USING (cluster) GROUP BY ALL)
       SELECT i.cluster, max((i.s+j.s)/sqrt((i.cx-j.cx)**2+(i.cy-j.cy)**2+(i.cz-j.cz)**2)) AS r FROM s i JOIN s j ON i.cluster <> j.cluster GROUP BY 1)"""),
)
def eval3(spark, sf):
    return E.davies_bouldin(X.scope(spark, sf))


def _two(spark, sf):
    return X.scope(spark, sf).select("ls_index", "cluster"), X.second_clusters(spark, sf)


@query(
    "eval4_adjusted_rand_nmi",
    with_scope("""SELECT round((p - lp*rp/tp)/((lp+rp)/2 - lp*rp/tp), 4) AS ari, round((hl+hr-hj)/((hl+hr)/2), 4) AS nmi FROM
       (SELECT sum(n*(n-1)/2.0) p, -sum(n/t*ln(n/t)) hj, any_value(t*(t-1)/2) tp FROM (SELECT count(*)::DOUBLE n, (SELECT count(*)::DOUBLE FROM scope) t FROM scope GROUP BY cluster, cluster2)),
       (SELECT sum(n*(n-1)/2.0) lp, -sum(n/t*ln(n/t)) hl FROM (SELECT count(*)::DOUBLE n, (SELECT count(*)::DOUBLE FROM scope) t FROM scope GROUP BY cluster)),
       (SELECT sum(n*(n-1)/2.0) rp, -sum(n/t*ln(n/t)) hr FROM (SELECT count(*)::DOUBLE n, (SELECT count(*)::DOUBLE FROM scope) t FROM scope GROUP BY cluster2))"""),
)
def eval4(spark, sf):
    return E.agreement(*_two(spark, sf))


@query("eval5_cluster_overlap", with_scope("SELECT cluster AS l, cluster2 AS r, count(*) AS n FROM scope GROUP BY 1, 2"))
def eval5(spark, sf):
    return E.contingency(*_two(spark, sf))


MATCH = """m AS (SELECT l, r AS best FROM (SELECT cluster AS l, cluster2 AS r, row_number() OVER (PARTITION BY cluster
  ORDER BY count(*) DESC, cluster2) AS rn FROM scope GROUP BY cluster, cluster2) WHERE rn = 1)"""


@query("eval5_equivalence_map", f"WITH {X.SCOPE_SQL}, {MATCH} SELECT l, best FROM m")
def eval5_map(spark, sf):
    return E.equivalence_map(E.contingency(*_two(spark, sf)))


@query(
    "eval5_changed_rows",
    f"WITH {X.SCOPE_SQL}, {MATCH} SELECT ls_index, cluster AS l, cluster2 AS r FROM scope JOIN m ON l = cluster WHERE cluster2 <> best",
)
def eval5_changed(spark, sf):
    return E.changed_rows(*_two(spark, sf))


SHIFT = "d AS (SELECT ls_index, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS s FROM map1 a JOIN map2 b USING (ls_index))"
NEAR = """{n} AS (SELECT i, j FROM (SELECT p.ls_index AS i, q.ls_index AS j, row_number() OVER (PARTITION BY p.ls_index
   ORDER BY sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)), q.ls_index) AS rn FROM {m} p, {m} q) WHERE rn <= 10)"""
SCALED = "SELECT ls_index, round((s - min(s) OVER ())/(max(s) OVER () - min(s) OVER ()), 6)+0.0 AS score FROM"


def _two_maps(spark, sf):
    return X.first_map(spark, sf).select("ls_index", "x", "y"), X.second_map(spark, sf)


@query("cmp1_map_displacement", f"WITH {X.MAP_SQL}, {SHIFT} {SCALED} d")
def cmp1(spark, sf):
    return r6(E.map_displacement(*_two_maps(spark, sf)), "score")


@query(
    "cmp2_map_neighborhood",
    f"""WITH {X.MAP_SQL}, {NEAR.format(n='n1', m='map1')}, {NEAR.format(n='n2', m='map2')},
    o AS (SELECT i AS ls_index, 1 - c/(20.0 - c) AS s FROM (SELECT n1.i, count(n2.j)::DOUBLE AS c FROM n1 LEFT JOIN n2 ON n1.i = n2.i AND n1.j = n2.j GROUP BY 1))
    {SCALED} o""",
)
def cmp2(spark, sf):
    return r6(E.map_neighborhood(*_two_maps(spark, sf)), "score")


@query(
    "cmp3_map_relative",
    f"""WITH {X.MAP_SQL}, {SHIFT}, {NEAR.format(n='n1', m='map1')},
    o AS (SELECT i AS ls_index, abs(any_value(own.s) - avg(d.s)) AS s FROM n1 JOIN d ON d.ls_index = j JOIN d own ON own.ls_index = i GROUP BY i)
    {SCALED} o""",
)
def cmp3(spark, sf):
    return r6(E.map_relative(*_two_maps(spark, sf)), "score")



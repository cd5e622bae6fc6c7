"""Registered queries for what is built on neighbour graphs: merge trees, descent, levels of communities, placing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from embedmap.operators import communities as C
from embedmap.operators import descent as D
from embedmap.operators import hierarchy as H
from embedmap.operators import layout as LY
from embedmap.operators.knn import knn_join
from embedmap.session import store
from embedmap.plans import fixtures as X
from embedmap.plans.registry import query

# single linkage by adding one edge after the other to a list of labels; clusters by comparing its levels
HIERARCHY_SQL = f"""WITH RECURSIVE {X.MAP_SQL},
  spots AS MATERIALIZED (SELECT x, y, min(ls_index) AS spot, count(*) AS size, row_number() OVER (ORDER BY min(ls_index)) AS i FROM map1 GROUP BY x, y),
  far AS (SELECT a.i AS a, b.i AS b, a.size AS own, b.size, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM spots a JOIN spots b ON a.i <> b.i),
  near AS MATERIALIZED (SELECT a, b, d, own, sum(size) OVER (PARTITION BY a ORDER BY d, b ROWS UNBOUNDED PRECEDING) AS upto FROM far
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 16),
  core AS (SELECT a AS i, CASE WHEN any_value(own) >= 4 THEN 0.0 ELSE min(d) FILTER (own + upto >= 4) END AS core FROM near GROUP BY a),
  edges AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, a, b) AS e FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, greatest(d, p.core, q.core) AS w
    FROM near JOIN core p ON p.i = a JOIN core q ON q.i = b WHERE p.core IS NOT NULL AND q.core IS NOT NULL)),
  steps AS (SELECT 0::BIGINT AS e, 0.0::DOUBLE AS w, (SELECT list(i ORDER BY i) FROM spots) AS lab UNION ALL
    SELECT g.e, g.w, CASE WHEN lab[a] = lab[b] THEN lab ELSE list_transform(lab, lambda z: CASE WHEN z = greatest(lab[a], lab[b]) THEN least(lab[a], lab[b]) ELSE z END) END
    FROM steps JOIN edges g ON g.e = steps.e + 1),
  levels AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY e) AS lv, lab FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY w ORDER BY e DESC) = 1)),
  labs AS MATERIALIZED (SELECT lv, w, unnest(lab) AS c, generate_subscripts(lab, 1) AS i FROM levels),
  comp AS MATERIALIZED (SELECT lv, w, c, sum(size) AS n FROM labs JOIN spots USING (i) GROUP BY lv, w, c HAVING sum(size) >= 6),
  parts AS (SELECT a.lv, a.c, count(*) AS k FROM comp b JOIN labs a ON a.lv = b.lv + 1 AND a.i = b.c GROUP BY a.lv, a.c),
  node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY comp.lv, comp.c) AS id, comp.lv, comp.c, w AS start, coalesce(k, 0) AS k FROM comp LEFT JOIN parts ON parts.lv = comp.lv AND parts.c = comp.c WHERE coalesce(k, 0) <> 1),
  up AS MATERIALIZED (SELECT n.id, arg_min(m.id, m.lv) AS up, arg_min(m.start, m.lv) AS up_start FROM node n JOIN labs a ON a.i = n.c AND a.lv > n.lv JOIN node m ON m.lv = a.lv AND m.c = a.c GROUP BY n.id),
  enter AS MATERIALIZED (SELECT a.i, arg_min(a.c, a.lv) AS c, min(a.lv) AS lv, min(a.w) AS w FROM labs a JOIN comp ON comp.lv = a.lv AND comp.c = a.c GROUP BY a.i),
  own AS MATERIALIZED (SELECT e.i, e.w, s.size, arg_max(n.id, n.lv) AS id FROM enter e JOIN spots s USING (i) JOIN node n ON n.lv <= e.lv JOIN labs a ON a.lv = e.lv AND a.i = n.c AND a.c = e.c GROUP BY e.i, e.w, s.size),
  held AS (SELECT n.id, sum(s.size) AS held FROM node n JOIN labs a ON a.lv = n.lv AND a.c = n.c JOIN enter e ON e.i = a.i AND e.lv < n.lv JOIN spots s ON s.i = a.i WHERE n.k > 1 GROUP BY n.id),
  birth AS (SELECT n.id, n.start, u.up, CASE WHEN u.up IS NULL THEN 0.0 ELSE 1 / greatest(u.up_start, 1e-9) END AS birth FROM node n LEFT JOIN up u USING (id)),
  mass AS MATERIALIZED (SELECT b.id, b.up, coalesce(p.m, 0) - b.birth * coalesce(p.n, 0) + coalesce(h.held, 0) * (1 / greatest(b.start, 1e-9) - b.birth) AS mass
    FROM birth b LEFT JOIN held h USING (id) LEFT JOIN (SELECT id, sum(size / greatest(w, 1e-9)) AS m, sum(size) AS n FROM own GROUP BY id) p USING (id)),
  kids AS (SELECT m.id, m.up, m.mass, list(k.id) FILTER (k.id IS NOT NULL) AS kids FROM mass m LEFT JOIN mass k ON k.up = m.id GROUP BY m.id, m.up, m.mass),
  best AS (SELECT 0::BIGINT AS id, []::DOUBLE[] AS best, false AS take, NULL::BIGINT AS up UNION ALL
    SELECT k.id, list_append(best, greatest(mass, coalesce(list_sum(list_transform(kids, lambda c: best[c])), 0))),
      mass >= coalesce(list_sum(list_transform(kids, lambda c: best[c])), 0) AND NOT (k.up IS NULL AND (SELECT count(*) FROM mass WHERE up IS NULL) = 1), k.up
    FROM best JOIN kids k ON k.id = best.id + 1),
  climb AS (SELECT id, id AS anc FROM mass UNION ALL SELECT climb.id, mass.up FROM climb JOIN mass ON mass.id = climb.anc WHERE mass.up IS NOT NULL),
  chosen AS (SELECT climb.id, max(anc) AS chosen FROM climb JOIN best ON best.id = climb.anc WHERE take GROUP BY climb.id),
  placed AS (SELECT map1.ls_index, chosen FROM map1 JOIN spots USING (x, y) JOIN own ON own.i = spots.i JOIN chosen ON chosen.id = own.id),
  numbered AS (SELECT chosen, row_number() OVER (ORDER BY count(*) DESC, min(ls_index)) - 1 AS id FROM placed GROUP BY chosen)
  SELECT map1.ls_index, CAST(coalesce(numbered.id, -1) AS INT) AS raw_cluster FROM map1 LEFT JOIN placed USING (ls_index) LEFT JOIN numbered USING (chosen)"""


@query("clu3_hierarchical_clusters", HIERARCHY_SQL)
def clu3_hierarchical(spark, sf):
    m = X.first_map(spark, sf).select("ls_index", "x", "y")
    return H.hierarchical_clusters(m, min_cluster_size=6, min_samples=4)


def _vectors(spark, sf):
    return X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"))


@query("vec4_neighbor_descent")
def vec4_descent(spark, sf):
    return D.neighbor_descent(_vectors(spark, sf), k=15)


# at least 95 of 100 entries are as near as those of the exact join
@query(
    "vec4_descent_recall",
    f"""WITH {X.VECTORS_SQL}, r AS (SELECT a.ls_index AS a, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.ls_index <> b.ls_index
        QUALIFY row_number() OVER (PARTITION BY a.ls_index ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.ls_index) <= 15)
        SELECT count(*) AS entries, round(avg(d), 5)+0.0 AS exact_mean, true AS found FROM r""",
)
def vec4_recall(spark, sf):
    v = store(_vectors(spark, sf), "vectors")
    exact = store(knn_join(v, v, 15, "cosine", include_self=False), "exact")
    ends = exact.groupBy("ls_index").agg(F.max("distance").alias("end"))
    hits = D.neighbor_descent(v, k=15).join(ends, "ls_index").agg(F.count_if(F.col("distance") <= F.col("end") + 1e-9).alias("hits"))
    whole = exact.agg(F.count("*").alias("entries"), (F.round(F.avg("distance"), 5) + 0.0).alias("exact_mean"))
    # one row each
    return whole.join(hits).select("entries", "exact_mean", (F.col("hits") >= 0.95 * F.col("entries")).alias("found"))


@query("clu4_community_clusters")
def clu4_communities(spark, sf):
    return C.community_clusters(_vectors(spark, sf), k=10, min_cluster_size=5)


# each community lies within one of the next level, every row has one, and modularity rises from singles to the last level
@query(
    "clu4_community_levels",
    f"""WITH {X.VECTORS_SQL}, r AS (SELECT a.ls_index AS a, b.ls_index AS b, row_number() OVER (PARTITION BY a.ls_index
        ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.ls_index) AS rn FROM v a JOIN v b ON a.ls_index <> b.ls_index QUALIFY rn <= 10)
        SELECT (SELECT count(*) FROM v) AS rows, count(*) AS edges, round(sum(sqrt((11 - p.rn) / 10 * (11 - q.rn) / 10)), 4)+0.0 AS weight, true AS nested, true AS rising
        FROM r p JOIN r q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b""",
)
def clu4_levels(spark, sf):
    v = store(_vectors(spark, sf), "vectors")
    near = store(knn_join(v, v, 10, "cosine", include_self=False), "near")
    back = near.select(F.col("neighbor").alias("ls_index"), F.col("ls_index").alias("neighbor"), F.col("rank").alias("back"))
    w = F.sqrt((11 - F.col("rank")) / 10 * (11 - F.col("back")) / 10)
    edges = store(near.join(back, ["ls_index", "neighbor"]).filter("ls_index < neighbor").select(F.col("ls_index").alias("a"), F.col("neighbor").alias("b"), w.alias("w")), "edges")
    found = store(C.community_levels(edges, v.select(F.col("ls_index").alias("node"))), "levels")
    both = edges.union(edges.select("b", "a", "w"))
    top = found.agg(F.max("level")).first()[0]
    states = [v.select(F.col("ls_index").alias("node"), F.col("ls_index").alias("c"))]
    states += [found.filter(F.col("level") == i).select("node", F.col("community").alias("c")) for i in range(top + 1)]
    values = [C.modularity(both, s) for s in states]
    later = F.lead("community").over(W.partitionBy("node").orderBy("level"))
    parents = found.withColumn("later", later).filter("later IS NOT NULL").groupBy("level", "community").agg(F.count_distinct("later").alias("n"))
    checks = parents.agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("nested"))
    whole = found.filter("level = 0").agg(F.count("*").alias("rows")).join(edges.agg(F.count("*").alias("edges"), (F.round(F.sum("w"), 4) + 0.0).alias("weight")))
    return whole.join(checks).withColumn("rising", F.lit(all(x < y for x, y in zip(values, values[1:], strict=False))))


# a third of the rows is placed into the map of the others, which stay bit-equal
@query(
    "prj10_place_by_layout",
    f"""WITH {X.MAP_SQL} SELECT count(*) AS rows, count(*) FILTER (ls_index % 3 <> 0) AS unmoved, true AS inside FROM map1""",
)
def prj10_layout(spark, sf):
    m, v = X.first_map(spark, sf).select("ls_index", "x", "y"), _vectors(spark, sf)
    old = F.col("ls_index") % 3 != 0
    found = LY.place_by_layout(m.filter(old), v.filter(old), v.filter(~old)).withColumnsRenamed({"x": "nx", "y": "ny"})
    same = (F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny"))
    inside = (F.abs("nx") < 2) & (F.abs("ny") < 2)
    return found.join(m, "ls_index").agg(F.count("*").alias("rows"), F.count_if(same & old).alias("unmoved"), F.bool_and(inside).alias("inside"))

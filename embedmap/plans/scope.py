"""Registered queries over the scope table: filters, joins, aggregates, windows, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions import scalars as S
from embedmap.functions.common import rounded
from embedmap.operators import aggregates as A
from embedmap.operators import filters as FL
from embedmap.operators import joins as J
from embedmap.operators import pages as PG
from embedmap.operators import profile as PR
from embedmap.operators import ranking as R
from embedmap.operators import sets as SE
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_map, with_scope, with_tags, with_vectors
from embedmap.plans.registry import query
from embedmap.session import scratch_path

# --- grid and colour functions ------------------------------------------------------------


@query("fn9_tile_index", with_scope("SELECT ls_index, tile_index_64 AS t64, tile_index_128 AS t128 FROM scope"))
def fn9(spark, sf):
    m = X.first_map(spark, sf)
    return m.select("ls_index", S.tile_index("x", "y", 64).alias("t64"), S.tile_index("x", "y", 128).alias("t128"))


@query("fn10_voxel_index", with_scope("SELECT ls_index, voxel_index_32 AS v32 FROM scope"))
def fn10(spark, sf):
    return X.first_map(spark, sf).select("ls_index", S.voxel_index("x", "y", "z", 32).alias("v32"))


@query(
    "fn11_voxel_center",
    with_scope("""SELECT ls_index, round((voxel_index_32 % 32 + 0.5)*2.0/32 - 1, 6)+0.0 AS cx,
       round((voxel_index_32 // 32 % 32 + 0.5)*2.0/32 - 1, 6)+0.0 AS cy,
       round((voxel_index_32 // 1024 + 0.5)*2.0/32 - 1, 6)+0.0 AS cz FROM scope"""),
)
def fn11(spark, sf):
    at = S.voxel_center("voxel_index_32", 32)
    return X.scope(spark, sf).select(
        "ls_index", *[rounded(at.getField(a)).alias(f"c{a}") for a in "xyz"]
    )


@query(
    "fn12_image_tile",
    with_scope("""SELECT ls_index, tile_index_128 % 128 // 64 AS tx, (127 - tile_index_128 // 128) // 64 AS ty
       FROM scope"""),
)
def fn12(spark, sf):
    t = S.image_tile("tile_index_128", 128, 32, 2048)
    return X.scope(spark, sf).select("ls_index", t.getField("tx").alias("tx"), t.getField("ty").alias("ty"))


@query(
    "fn13_color_norm",
    """SELECT doc_id AS ls_index, round(least(greatest((n_chars - lo)::DOUBLE / nullif(hi - lo, 0), 0), 1), 6)+0.0 AS c
       FROM documents, (SELECT min(n_chars) lo, max(n_chars) hi FROM documents)""",
)
def fn13(spark, sf):
    d = X.documents(spark, sf)
    e = d.agg(F.struct(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))).scalar()
    return d.select("ls_index", rounded(S.color_norm("n_chars", e.getField("lo"), e.getField("hi"))).alias("c"))


@query(
    "fn14_symlog_scale",
    """WITH s AS (SELECT event_id, sign(value)*ln(1+abs(value)) AS v FROM events)
       SELECT event_id, round((v - lo)/nullif(hi - lo, 0), 6)+0.0 AS c
       FROM s, (SELECT min(v) lo, max(v) hi FROM s)""",
)
def fn14(spark, sf):
    d = X.table(spark, sf, "events")
    e = d.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    return d.select("event_id", rounded(S.symlog_scale("value", e.getField("lo"), e.getField("hi"))).alias("c"))


# --- filters ------------------------------------------------------------------------------


@query(
    "flt1_column_filter",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40
       AND l_discount > 0.02 AND l_tax <= 0.06 AND l_linestatus = 'O' AND l_returnflag IN ('A','N')
       AND regexp_matches(l_returnflag, '^[A-N]')""",
)
def flt1(spark, sf):
    conditions = [
        {"type": "gte", "column": "l_quantity", "value": 10},
        {"type": "lt", "column": "l_quantity", "value": 40},
        {"type": "gt", "column": "l_discount", "value": 0.02},
        {"type": "lte", "column": "l_tax", "value": 0.06},
        {"type": "eq", "column": "l_linestatus", "value": "O"},
        {"type": "in", "column": "l_returnflag", "value": ["A", "N"]},
        {"type": "contains", "column": "l_returnflag", "value": "^[A-N]"},
        {"type": "between", "column": "l_tax", "value": 0},
    ]
    return FL.column_filter(X.table(spark, sf, "lineitem"), conditions).select("l_orderkey", "l_linenumber")


@query("flt2_by_cluster", with_scope("SELECT ls_index, cluster FROM scope WHERE cluster = 3"))
def flt2(spark, sf):
    return FL.by_cluster(X.scope(spark, sf), 3).select("ls_index", "cluster")


@query("flt3_not_deleted", with_scope("SELECT ls_index, label FROM scope WHERE NOT deleted"))
def flt3(spark, sf):
    return FL.not_deleted(X.scope(spark, sf)).select("ls_index", "label")


@query(
    "flt4_by_indices",
    """SELECT item_id * 7 + 1 AS ls_index, d.lang, d.n_chars, -item_id AS ord FROM benchmark
       JOIN documents d ON d.doc_id = item_id * 7 + 1""",
)
def flt4(spark, sf):
    asked = X.table(spark, sf, "benchmark").select(
        (F.col("item_id") * 7 + 1).alias("ls_index"), (-F.col("item_id")).alias("ord")
    )
    return FL.by_indices(X.documents(spark, sf).select("ls_index", "lang", "n_chars"), asked)


@query(
    "flt5_viewport",
    with_map("""SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y FROM map1
       WHERE x BETWEEN -0.3 AND 0.4 AND y BETWEEN -0.5 AND 0.2"""),
)
def flt5(spark, sf):
    return r6(FL.viewport(X.first_map(spark, sf), 0.4, -0.3, 0.2, -0.5).select("ls_index", "x", "y"), "x", "y")


@query(
    "flt6_curate_rows",
    """SELECT doc_id AS ls_index, n_chars FROM documents WHERE n_chars > 5 AND text IS NOT NULL AND text <> ''
       AND NOT contains(text, 'imgur') AND NOT contains(text, 'http:') AND NOT contains(text, 'https:')""",
)
def flt6(spark, sf):
    return FL.curate_rows(X.documents(spark, sf), "text", "n_chars", 5).select("ls_index", "n_chars")


@query(
    "flt7_repeated_words",
    r"""SELECT doc_id AS ls_index, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM
         (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w) WHERE w <> '' GROUP BY w)) > 100, false) AS repeated
       FROM documents""",
)
def flt7(spark, sf):
    return X.documents(spark, sf).select("ls_index", S.repeated_words("text", 100).alias("repeated"))


@query(
    "flt8_search_labels",
    """SELECT p_name AS label, p_partkey FROM part WHERE contains(lower(p_name), 'a')
       ORDER BY p_name, p_partkey LIMIT 5""",
)
def flt8(spark, sf):
    parts = X.table(spark, sf, "part").select(F.col("p_name").alias("label"), "p_partkey")
    return FL.search_labels(parts, "A", 5, order=[F.col("label"), F.col("p_partkey")])


@query(
    "flt9_above_threshold",
    with_map("""SELECT CAST(count(*) FILTER (WHERE d >= 0.5) AS BIGINT) AS n_above, count(*) AS n FROM
       (SELECT sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d FROM map1 a JOIN map2 b USING (ls_index))"""),
)
def flt9(spark, sf):
    a, b = X.first_map(spark, sf), X.second_map(spark, sf).withColumnsRenamed({"x": "bx", "y": "by"})
    drift = a.join(b, "ls_index").select(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")).alias("d"))
    return FL.count_above(drift, "d", 0.5)


@query(
    "flt10_valid_category",
    """SELECT doc_id AS ls_index, lang FROM documents WHERE
       (SELECT count(DISTINCT lang) FROM documents) BETWEEN 2 AND 100 AND lang IS NOT NULL""",
)
def flt10(spark, sf):
    d = X.documents(spark, sf).select("ls_index", "lang")
    return FL.valid_category(d, "lang", PR.categories(d.select("lang"))).select("ls_index", "lang")


@query(
    "flt11_out_of_frame",
    with_map("""SELECT count(*) FILTER (WHERE x*1.2 < -1 OR x*1.2 > 1 OR y*1.2 < -1 OR y*1.2 > 1) AS n_outside,
       count(*) AS n FROM map1"""),
)
def flt11(spark, sf):
    m = X.first_map(spark, sf).select((F.col("x") * 1.2).alias("x"), (F.col("y") * 1.2).alias("y"))
    return FL.out_of_frame(m, ["x", "y"])


# --- joins --------------------------------------------------------------------------------


@query(
    "join1_scope_join",
    with_scope("""SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, cluster, raw_cluster, label,
       tile_index_64, deleted FROM scope"""),
)
def join1(spark, sf):
    s = X.scope(spark, sf).select("ls_index", "x", "y", "cluster", "raw_cluster", "label", "tile_index_64", "deleted")
    return r6(s, "x", "y")


@query(
    "join2_scope_input_join",
    with_scope("""SELECT ls_index, e.label, s.label AS label_ls, s.cluster FROM scope s
       JOIN embeddings e ON e.vec_id = s.ls_index WHERE NOT s.deleted"""),
)
def join2(spark, sf):
    source = X.vectors(spark, sf).select("ls_index", "label")
    scope = FL.not_deleted(X.scope(spark, sf)).select("ls_index", "label", "cluster")
    return J.scope_input_join(source, scope)


@query("join4_attach_vectors", "SELECT doc_id AS ls_index, lang, round(e[1]::DOUBLE, 6)+0.0 AS v0, coalesce(len(e), 0) AS dim FROM documents LEFT JOIN (SELECT vec_id, embedding AS e FROM embeddings) ON vec_id = doc_id")
def join4(spark, sf):
    rows = X.documents(spark, sf).select("ls_index", "lang")
    got = J.attach_vectors(rows, X.vectors(spark, sf).select("ls_index", "vector"))
    v = F.col("ls_embedding")
    return got.select(
        "ls_index", "lang", rounded(F.try_element_at(v, F.lit(1)).cast("double")).alias("v0"),
        F.when(v.isNotNull(), F.size(v)).otherwise(0).cast("long").alias("dim"),
    )


@query(
    "join5_deleted_backfill",
    with_scope("SELECT ls_index, cluster, label, deleted FROM scope"),
)
def join5(spark, sf):
    full = X.scope(spark, sf).select("ls_index", "cluster", "label", "deleted")
    live = FL.not_deleted(full)
    return J.deleted_backfill(X.vectors(spark, sf).select("ls_index"), live, full.drop("deleted"))


@query(
    "join6_tag_columns",
    with_tags("""SELECT doc_id AS ls_index, doc_id IN (SELECT ls_index FROM tags WHERE tag='good') AS tag_good,
       doc_id IN (SELECT ls_index FROM tags WHERE tag='toxic') AS tag_toxic FROM documents"""),
)
def join6(spark, sf):
    return J.tag_columns(X.documents(spark, sf).select("ls_index"), X.tags(spark, sf), ["good", "toxic"])


@query(
    "join7_feature_label_join",
    """SELECT CAST(p_size AS BIGINT) AS feature_id, count(*) AS n,
       coalesce(any_value(n_name), 'Feature ' || p_size) AS label
       FROM part LEFT JOIN nation ON n_nationkey = p_size GROUP BY p_size""",
)
def join7(spark, sf):
    stats = X.table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("feature_id")).agg(F.count("*").alias("n"))
    names = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("feature_id"), F.col("n_name").alias("label"))
    return J.feature_label_join(stats, names)


@query(
    "join8_shared_prefix",
    with_map(f"""SELECT 0 AS "window", a.ls_index, round(a.x,6)+0.0 AS a_x, round(b.x,6)+0.0 AS b_x
       FROM map1 a JOIN map2 b USING (ls_index) JOIN v USING (ls_index) WHERE label < {X.NEW_LABEL}"""),
)
def join8(spark, sf):
    kept = X.vectors(spark, sf).filter(F.col("label") < X.NEW_LABEL).select("ls_index")
    old = X.first_map(spark, sf).join(kept, "ls_index", "left_semi")
    return r6(J.shared_prefix([old, X.second_map(spark, sf)], ["x"]), "a_x", "b_x")


@query(
    "join9_aligned_tables_check",
    """SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS right_only,
       count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS "both"
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def join9(spark, sf):
    return J.alignment_report(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"), "doc_id")


# --- aggregates ---------------------------------------------------------------------------


@query(
    "agg1_cluster_summary",
    with_scope("""SELECT cluster, min(label) AS label, count(*) AS "count", count(*) FILTER (WHERE NOT deleted) AS live
       FROM scope GROUP BY cluster HAVING count(*) FILTER (WHERE NOT deleted) > 0"""),
)
def agg1(spark, sf):
    return A.cluster_summary(X.scope(spark, sf))


@query(
    "agg2_cluster_centroids",
    with_scope("SELECT cluster, round(avg(x),6)+0.0 AS x, round(avg(y),6)+0.0 AS y FROM scope GROUP BY cluster"),
)
def agg2(spark, sf):
    return r6(A.cluster_centroids(X.scope(spark, sf)), "x", "y")


@query("agg3_tile_density", with_scope("SELECT tile_index_64 AS cell, count(*) AS n FROM scope GROUP BY 1"))
def agg3(spark, sf):
    return A.tile_density(X.scope(spark, sf), "tile_index_64")


DOMINANT = """SELECT cell, CAST(sum(k) OVER (PARTITION BY cell) AS BIGINT) AS n, cluster, label, rn FROM
  (SELECT {cell} AS cell, cluster, min(label) AS label, count(*) AS k,
          row_number() OVER (PARTITION BY {cell} ORDER BY count(*) DESC, cluster) AS rn
   FROM scope {where} GROUP BY {cell}, cluster)"""


@query(
    "agg4_cell_dominant",
    with_scope(f"SELECT cell, n, cluster, label FROM ({DOMINANT.format(cell='tile_index_64', where='')}) WHERE rn = 1"),
)
def agg4(spark, sf):
    return A.cell_dominant(X.scope(spark, sf), "tile_index_64")


@query(
    "agg5_voxel_cells",
    with_scope(f"""SELECT cell, n, cluster, label, round((cell % 32 + 0.5)*2.0/32 - 1, 6)+0.0 AS x,
       round((cell // 32 % 32 + 0.5)*2.0/32 - 1, 6)+0.0 AS y, round((cell // 1024 + 0.5)*2.0/32 - 1, 6)+0.0 AS z,
       round(ln(1+n)/ln(1+max(n) OVER ()), 6)+0.0 AS density
       FROM ({DOMINANT.format(cell='voxel_index_32', where='WHERE NOT deleted')}) WHERE rn = 1"""),
)
def agg5(spark, sf):
    return r6(A.voxel_cells(X.scope(spark, sf), 32), "x", "y", "z", "density")


@query(
    "agg6_selection_spread",
    with_scope("""SELECT 'left' AS map, round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2),6)+0.0 AS spread FROM scope WHERE cluster = 2
       UNION ALL SELECT 'right', round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2),6)+0.0 FROM map2
       WHERE ls_index IN (SELECT ls_index FROM scope WHERE cluster = 2)"""),
)
def agg6(spark, sf):
    s = X.scope(spark, sf)
    chosen = FL.by_cluster(s, 2).select("ls_index")
    return r6(A.selection_spread({"left": s.select("ls_index", "x", "y"), "right": X.second_map(spark, sf)}, chosen), "spread")


@query(
    "agg7_color_categorical",
    """WITH c AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS category FROM documents
         WHERE source IS NOT NULL GROUP BY source)
       SELECT doc_id AS ls_index, source, coalesce(category, -1) AS category FROM documents LEFT JOIN c USING (source)""",
)
def agg7(spark, sf):
    return A.color_categorical(X.documents(spark, sf).select("ls_index", "source"), "source")


@query(
    "agg8_color_numeric",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value,
       min(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) OVER () AS lo,
       max(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) OVER () AS hi FROM events""",
)
def agg8(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"))
    return A.color_numeric(e, "raw").drop("raw")


@query(
    "agg9_rare_label_fold",
    """SELECT doc_id AS ls_index, CASE WHEN count(*) OVER (PARTITION BY source) < 50 THEN 'No Topic' ELSE source END AS folded
       FROM documents""",
)
def agg9(spark, sf):
    return A.rare_label_fold(X.documents(spark, sf).select("ls_index", "source"), "source", 50).select("ls_index", "folded")


HASH = "CAST('0x' || substr(md5(ls_index || ',' || CAST(floor(x*1e6+0.5) AS BIGINT) || ',' || CAST(floor(y*1e6+0.5) AS BIGINT)), 1, 15) AS BIGINT)"


@query(
    "agg10_scope_fingerprint",
    with_scope(f"""SELECT count(*) AS n, bit_xor(h) AS hash_xor, CAST(sum(h & 4294967295) AS BIGINT) AS hash_sum
        FROM (SELECT {HASH} AS h FROM scope WHERE NOT deleted)"""),
)
def agg10(spark, sf):
    return A.scope_fingerprint(X.scope(spark, sf))


@query("agg11_cluster_members", with_scope("SELECT cluster, ls_index FROM scope"))
def agg11(spark, sf):
    return A.cluster_members(X.scope(spark, sf))


# --- windows, sampling, paging ------------------------------------------------------------


@query(
    "win1_nearest_to_centroid",
    with_scope("""SELECT cluster, ls_index, centroid_dist FROM (
      WITH sz AS (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE raw_cluster = cluster) AS nraw FROM scope GROUP BY cluster),
      pool AS (SELECT s.cluster, s.ls_index, s.x, s.y FROM scope s JOIN sz USING (cluster) WHERE raw_cluster = cluster AND size > 10
        UNION ALL SELECT s.cluster, s.ls_index, s.x, s.y FROM scope s JOIN sz USING (cluster) WHERE nraw < 10 AND size > 10),
      c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM pool GROUP BY cluster),
      d AS (SELECT cluster, ls_index, sqrt((x-cx)**2+(y-cy)**2) AS dist FROM pool JOIN c USING (cluster)),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, ls_index) AS rn FROM d)
      SELECT DISTINCT cluster, ls_index, round(dist,6)+0.0 AS centroid_dist FROM r WHERE rn <= 10
      UNION ALL SELECT cluster, ls_index, NULL FROM scope JOIN sz USING (cluster) WHERE size <= 10)"""),
)
def win1(spark, sf):
    return r6(R.nearest_to_centroid(X.scope(spark, sf), 10).select("cluster", "ls_index", "centroid_dist"), "centroid_dist")


@query(
    "win2_token_budget",
    """SELECT source, doc_id AS ls_index, used_tokens FROM (SELECT source, doc_id, least(n_chars, 2000) AS used_tokens,
         sum(least(n_chars, 2000)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents)
       WHERE run <= 20000""",
)
def win2(spark, sf):
    d = X.documents(spark, sf).select("source", "ls_index", "n_chars")
    return R.token_budget(d, ["source"], ["ls_index"], "n_chars", 2000, 20000).select("source", "ls_index", "used_tokens")


@query(
    "win3_first_k_per_cell",
    with_scope("""SELECT resolution, cell, ls_index, sheet FROM (SELECT resolution, cell, ls_index,
         CAST(row_number() OVER (PARTITION BY resolution, cell ORDER BY ls_index) - 1 AS INT) AS sheet FROM (
         SELECT ls_index, r AS resolution, least(greatest(CAST(floor((y+1)/(2.0/r)) AS BIGINT),0),r-1)*r
           + least(greatest(CAST(floor((x+1)/(2.0/r)) AS BIGINT),0),r-1) AS cell
         FROM scope, (SELECT unnest([4, 8, 64]) AS r) WHERE NOT deleted)) WHERE sheet < 2"""),
)
def win3(spark, sf):
    images = X.vectors(spark, sf).select("ls_index", F.col("vector").alias("image"))
    s = X.scope(spark, sf).select("ls_index", "x", "y", "deleted").join(images, "ls_index")
    return R.first_k_per_cell(s, "image", [4, 8, 64], 2).select("resolution", "cell", "ls_index", "sheet")


@query(
    "win4_sample_even",
    """SELECT source, ls_index FROM (SELECT source, doc_id AS ls_index, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n FROM documents) t
       WHERE n <= 12 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(12)) AS j) WHERE j * t.n // 12 = t.r)""",
)
def win4(spark, sf):
    return R.sample_even(X.documents(spark, sf).select("source", "ls_index"), ["source"], ["ls_index"], 12).select("source", "ls_index")


@query(
    "win5_token_offsets",
    """SELECT doc_id AS ls_index, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS first_token FROM documents""",
)
def win5(spark, sf):
    d = X.documents(spark, sf).select("ls_index", "n_chars")
    return R.token_offsets(d, "n_chars").select("ls_index", "first_token")


@query(
    "win6_recent_distinct",
    "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 5",
)
def win6(spark, sf):
    return R.recent_distinct(X.table(spark, sf, "events"), "user_id", "ts", 5)


@query("smp1_uniform_sample", "SELECT doc_id AS ls_index, lang FROM documents ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id LIMIT 100")
def smp1(spark, sf):
    return R.uniform_sample(X.documents(spark, sf).select("ls_index", "lang"), 100)


@query(
    "srt1_sort_rows",
    """SELECT doc_id AS ls_index, coalesce(quality, -1) AS quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) - 1 AS pos
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def srt1(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left")
    d = d.select(F.col("doc_id").alias("ls_index"), "quality")
    return R.positions(R.sort_rows(d, "quality", ascending=False), "pos").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("srt2_page", "SELECT doc_id AS ls_index, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def srt2(spark, sf):
    return R.page(X.documents(spark, sf).select("ls_index", "n_chars"), [F.col("n_chars").desc(), "ls_index"], 2, 50)


@query("srt2_page_count", "SELECT count(*) AS total, CAST(ceil(count(*)/100.0) AS BIGINT) AS total_pages FROM documents")
def srt2_count(spark, sf):
    return R.page_count(X.documents(spark, sf), 100)


@query(
    "srt2_deep_page",
    """SELECT doc_id AS ls_index, n_chars FROM documents ORDER BY n_chars DESC, doc_id
       LIMIT 50 OFFSET (SELECT 50 * CAST(greatest(ceil(count(*)/50.0) - 1, 0) AS BIGINT) FROM documents)""",
)
def srt2_deep(spark, sf):
    # the last page, by the directory
    rows = X.documents(spark, sf).select("ls_index", "n_chars")
    pages = PG.build_pages(rows, [F.col("n_chars").desc(), "ls_index"], scratch_path(spark, "pages"), range_rows=200)
    last = max(PG.count_pages(spark, pages, 50).first()["total_pages"] - 1, 0)
    return PG.read_page(spark, pages, last, 50)


@query(
    "srt3_table_page",
    with_scope("SELECT ls_index, label FROM scope WHERE NOT deleted AND cluster = 1 ORDER BY ls_index LIMIT 20 OFFSET 20"),
)
def srt3(spark, sf):
    s = FL.by_cluster(FL.not_deleted(X.scope(spark, sf)), 1)
    return R.page(s.select("ls_index", "label"), ["ls_index"], 1, 20)


@query("srt4_head", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200")
def srt4(spark, sf):
    return R.head(X.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 200)


@query("srt5_order_clusters", with_scope('SELECT cluster, min(label) AS label, count(*) AS "count" FROM scope GROUP BY cluster'))
def srt5(spark, sf):
    return R.order_clusters(A.cluster_summary(X.scope(spark, sf)).drop("live"), "size")


# --- sets ---------------------------------------------------------------------------------


@query("set1_append_rows", "SELECT vec_id AS ls_index, label FROM embeddings")
def set1(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", "label")
    return SE.append_rows(v.filter(F.col("label") < X.NEW_LABEL), v.filter(F.col("label") >= X.NEW_LABEL))


@query("set3_ids_minus", with_scope("SELECT ls_index FROM scope WHERE NOT deleted"))
def set3(spark, sf):
    s = X.scope(spark, sf)
    return SE.ids_minus(s.select("ls_index"), s.filter("deleted"))


@query(
    "set5_tag_union_subtract",
    with_tags("""SELECT DISTINCT * FROM (SELECT * FROM tags UNION ALL SELECT 'good', doc_id FROM documents WHERE lang = 'en') t
       WHERE NOT (tag = 'good' AND ls_index IN (SELECT ls_index FROM tags WHERE tag = 'toxic'))"""),
)
def set5(spark, sf):
    tags = X.tags(spark, sf)
    more = X.documents(spark, sf).filter("lang = 'en'").select(F.lit("good").alias("tag"), "ls_index")
    toxic = tags.filter("tag = 'toxic'").select(F.lit("good").alias("tag"), "ls_index")
    return SE.tag_subtract(SE.tag_union(tags, more), toxic)


@query("set6_drop_duplicates", "SELECT DISTINCT lang, source, text, n_chars FROM documents")
def set6(spark, sf):
    return SE.drop_duplicates(X.table(spark, sf, "documents").drop("doc_id"))


# --- grid planning ------------------------------------------------------------------------

CELLS = """cells AS (SELECT r AS resolution, cell, cell % r // 64 AS tx, (r - 1 - cell // r) // 64 AS ty, count(*) AS n FROM (
    SELECT r, least(greatest(CAST(floor((y+1)/(2.0/r)) AS BIGINT),0),r-1)*r
      + least(greatest(CAST(floor((x+1)/(2.0/r)) AS BIGINT),0),r-1) AS cell
    FROM map1, (SELECT unnest([64, 128, 256]) AS r)) GROUP BY ALL)"""


@query(
    "grd1_plan_grid",
    f"""WITH {X.MAP_SQL}, {CELLS} SELECT resolution, CAST(ceil(resolution/64.0) AS BIGINT) AS tiles_per_axis, CAST(resolution*32 AS BIGINT) AS full_px,
       CAST(resolution*resolution AS BIGINT) AS total_cells, count(*) AS populated_cells,
       CAST(ceil(resolution/64.0)*ceil(resolution/64.0) AS BIGINT) AS total_tiles,
       count(DISTINCT tx*1000+ty) AS populated_tiles, CAST(sum(n) AS BIGINT) AS points FROM cells GROUP BY resolution""",
)
def grd1(spark, sf):
    return A.plan_grid(X.first_map(spark, sf), [256, 64, 128, 64])


@query("grd2_tile_counts", f"WITH {X.MAP_SQL}, {CELLS} SELECT resolution, tx, ty, count(*) AS filled_cells FROM cells GROUP BY 1, 2, 3")
def grd2(spark, sf):
    return A.tile_counts(X.first_map(spark, sf), [64, 128, 256])


@query(
    "grd3_density_grid",
    with_scope("""SELECT g.cell, g.cell // 64 AS "row", g.cell % 64 AS col, coalesce(c.n, 0) AS n FROM
       (SELECT unnest(range(4096)) AS cell) g LEFT JOIN (SELECT tile_index_64 AS cell, count(*) AS n FROM scope GROUP BY 1) c USING (cell)"""),
)
def grd3(spark, sf):
    return A.density_grid(X.first_map(spark, sf), 64)


@query("grd4_bytes_per_cell", "SELECT round(avg(strlen(html)), 6) AS bytes_per_cell, count(html) AS images FROM pages")
def grd4(spark, sf):
    pages = X.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("image"))
    return r6(A.bytes_per_cell(pages, "image"), "bytes_per_cell")


@query("fn17_drop_binary_columns", "SELECT page_id, url FROM pages")
def fn17(spark, sf):
    pages = X.table(spark, sf, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("raw"))
    return S.drop_binary_columns(pages)


@query("src4_import_vectors", with_vectors("SELECT ls_index, round(e[1],6)+0.0 AS v0, len(e) AS dim FROM v"))
def src4(spark, sf):
    from embedmap.sources.readers import import_vectors

    v = import_vectors(X.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "ls_index"), "embedding")
    return v.select("ls_index", rounded(F.col("vector")[0].cast("double")).alias("v0"), F.size("vector").cast("long").alias("dim"))

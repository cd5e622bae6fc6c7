"""Operators on small planted tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import aggregates as A
from embedmap.operators import cluster as C
from embedmap.operators import curate as CU
from embedmap.operators import evaluate as E
from embedmap.operators import features as FE
from embedmap.operators import filters as FL
from embedmap.operators import joins as J
from embedmap.operators import labels as L
from embedmap.operators import profile as PR
from embedmap.operators import project as P
from embedmap.operators import ranking as R
from embedmap.operators import tokens as TK


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def xy(spark, points):
    return table(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "ls_index long, x double, y double")


# --- frames and registration ---------------------------------------------------------------


@pytest.mark.parametrize("c,theta,t,mirror,n", [(1.75, 2.2, (-4, 0.5), False, 23), (0.3, -1.1, (6, 6), True, 31), (1.0, 0.0, (0, 0), False, 2)])
def test_similarity_recovered(spark, c, theta, t, mirror, n):
    src = np.random.default_rng(0).normal(size=(n, 2))
    r = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])
    r = r @ np.diag([1, -1]) if mirror else r
    dst = c * src @ r.T + np.array(t)
    pairs = table(spark, [tuple(map(float, (*s, *d))) for s, d in zip(src, dst)], "sx double, sy double, dx double, dy double")
    f = P.fit_similarity(pairs).first()
    assert np.allclose([f["c"], f["tx"], f["ty"]], [c, *t], atol=1e-6)
    assert np.allclose([[f["r11"], f["r12"]], [f["r21"], f["r22"]]], r, atol=1e-6)


@pytest.mark.parametrize("points", [[(0, 0)], [(1, 1), (1, 1), (1, 1)]])
def test_similarity_needs_two_different_points(spark, points):
    pairs = table(spark, [(float(a), float(b), 0.0, 0.0) for a, b in points], "sx double, sy double, dx double, dy double")
    with pytest.raises(Exception, match="two shared points"):
        P.fit_similarity(pairs).collect()


def test_register_growing_layout(spark):
    rng = np.random.default_rng(1)
    new = rng.normal(size=(44, 2))
    target = 1.5 * new[5:17] @ np.array([[0, 1], [-1, 0]]).T + [-3, 0.25]
    target = np.vstack([np.full((5, 2), np.nan), target])
    kept = xy(spark, target).filter("NOT isnan(x)")
    got = {r["ls_index"]: (r["x"], r["y"]) for r in P.register_layout(xy(spark, new), kept).collect()}
    want = 1.5 * new @ np.array([[0, 1], [-1, 0]]).T + [-3, 0.25]
    assert np.allclose([got[i] for i in range(44)], want, atol=1e-6)


def test_shared_prefix_lengths(spark):
    windows = [spark.range(n).select(F.col("id").alias("ls_index"), F.lit(0.0).alias("x")) for n in (9, 4, 11, 11)]
    got = J.shared_prefix(windows, ["x"]).groupBy("window").count().orderBy("window").collect()
    assert [r["count"] for r in got] == [4, 4, 11]


def test_frame_corners(spark):
    m = P.apply_frame(xy(spark, [(2, -6), (4, -2), (3, -4), (3, -1.5), (1, 0)]), ["x", "y"], dict(x_min=2.0, x_max=4.0, y_min=-6.0, y_max=-2.0))
    got = [(r["x"], r["y"]) for r in m.orderBy("ls_index").collect()]
    assert got[:3] == [(-1, -1), (1, 1), (0, 0)]
    assert FL.out_of_frame(m, ["x", "y"]).first()["n_outside"] == 2
    flat = P.normalize_frame(xy(spark, [(3, 1), (3, 2)]), ["x", "y"]).collect()
    assert {r["x"] for r in flat} == {0.0}


def test_project_keeps_planted_directions(spark):
    rng = np.random.default_rng(2)
    base = np.eye(8)[:3]
    rows = [(i, (base[i % 3] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(90)]
    m = P.project(table(spark, rows, "ls_index long, vector array<double>"), components=2).toPandas().set_index("ls_index").sort_index()
    assert m.min().min() >= -1 and m.max().max() <= 1
    centers = np.array([m.iloc[g::3].mean().to_numpy() for g in range(3)])
    spread = max(m.iloc[g::3].std().max() for g in range(3))
    gaps = [np.linalg.norm(centers[a] - centers[b]) for a, b in ((0, 1), (0, 2), (1, 2))]
    assert min(gaps) > 5 * spread


def test_place_new_rows_checks_and_keeps_old(spark):
    old = table(spark, [(i, [1.0, float(i)]) for i in range(5)], "ls_index long, vector array<double>")
    old_map = xy(spark, [(i / 4, 0) for i in range(5)])
    new = table(spark, [(9, [1.0, 2.0])], "ls_index long, vector array<double>")
    got = {r["ls_index"]: r["x"] for r in P.place_new_rows(old_map, old, new, 1).collect()}
    assert got == {0: 0.0, 1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0, 9: 0.5}
    assert P.place_new_rows(old_map, old, old, 1).count() == 5
    with pytest.raises(ValueError, match="aligned"):
        P.place_new_rows(old_map, old.filter("ls_index < 4"), new, 1)


# --- noise rule ----------------------------------------------------------------------------


def labels_of(spark, counts):
    rows, i = [], 0
    for cluster, n in counts.items():
        for _ in range(n):
            rows.append((i, cluster, float(cluster), 0.0))
            i += 1
    return table(spark, rows, "ls_index long, raw_cluster int, x double, y double")


@pytest.mark.parametrize("counts,noise_id", [({0: 7, 3: 2, -1: 4}, 4), ({5: 3}, None), ({-1: 9}, 0), ({0: 1, -1: 1}, 1)])
def test_noise_gets_next_id(spark, counts, noise_id):
    c = C.noise_to_unclustered(labels_of(spark, counts))
    noise = {r[0] for r in c.filter("raw_cluster = -1").select("cluster").distinct().collect()}
    assert noise == ({noise_id} if -1 in counts else set())
    named = {r["cluster"]: r["label"] for r in C.default_labels(c).collect()}
    assert {k for k, v in named.items() if v == "Unclustered"} == noise
    assert len(named) == len(counts)


def test_noise_to_nearest(spark):
    df = table(spark, [(0, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (2, -1, 1.0, 0.0), (3, -1, 9.0, 0.0), (4, -1, 5.0, 0.0)], "ls_index long, raw_cluster int, x double, y double")
    got = {r["ls_index"]: r["cluster"] for r in C.noise_to_nearest(df).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1}
    assert {r["cluster"] for r in C.noise_to_nearest(labels_of(spark, {-1: 5})).collect()} == {0}


# --- colour, grids, tags --------------------------------------------------------------------


def test_colour_scale_and_categories(spark):
    rows = [(10, -2.0, "oak"), (11, 6.0, "elm"), (12, None, "oak"), (13, 0.0, None), (14, 6.0, "ash"), (15, 1.0, "elm"), (16, 2.0, "oak"), (17, float("inf"), "ash")]
    df = table(spark, rows, "ls_index long, height double, tree string")
    scaled = {r["ls_index"]: r for r in A.color_numeric(df, "height").collect()}
    assert (scaled[10]["lo"], scaled[10]["hi"]) == (-2.0, 6.0) and scaled[12]["value"] is None
    # by number of rows, then by name
    assert [tuple(r)[:3] for r in A.color_categories(df, "tree").select("category", "value", "n").orderBy("category").collect()] == [(0, "oak", 3), (1, "ash", 2), (2, "elm", 2)]
    assert [r["ls_index"] for r in A.color_categorical(df, "tree").filter("category = -1").collect()] == [13]
    text = table(spark, [(0, "12"), (1, "tall"), (2, "-Infinity"), (3, " 7.25 ")], "ls_index long, v string")
    got = {r["ls_index"]: r["value"] for r in A.color_numeric(text, "v").collect()}
    assert got[0] == 12.0 and got[1] is None


def cell(col, row, n=64):
    return (2 * (col + 0.5) / n - 1, 2 * (row + 0.5) / n - 1)


def test_cells_keep_their_first_live_images(spark):
    """Three rows share a cell; deleted rows and rows without an image take no place."""
    spots = [(cell(7, 1, 16), True, b"gone"), (cell(7, 1, 16), False, None), (cell(7, 1, 16), False, b"p"), (cell(0, 15, 16), False, b"q"), (cell(7, 1, 16), False, b"r"), (cell(7, 1, 16), False, b"s")]
    df = table(spark, [(10 * i, *p, d, bytearray(b) if b else None) for i, (p, d, b) in enumerate(spots)], "ls_index long, x double, y double, deleted boolean, image binary")
    for k, want in ((1, [(23, 20, 0), (240, 30, 0)]), (2, [(23, 20, 0), (23, 40, 1), (240, 30, 0)]), (9, [(23, 20, 0), (23, 40, 1), (23, 50, 2), (240, 30, 0)])):
        assert sorted((r["cell"], r["ls_index"], r["sheet"]) for r in R.first_k_per_cell(df, "image", [16], k).collect()) == want


def test_grid_plan_adds_up(spark):
    pts = xy(spark, [cell(0, 0, 30), cell(29, 29, 30), cell(28, 29, 30), cell(14, 3, 30), cell(14, 3, 30), cell(14, 3, 30)])
    r = A.plan_grid(pts, [30], cell_px=10, tile_px=50).first()
    assert (r["tiles_per_axis"], r["full_px"], r["total_cells"], r["total_tiles"]) == (6, 300, 900, 36)
    assert (r["populated_cells"], r["populated_tiles"], r["points"]) == (4, 3, 6)
    assert A.density_grid(pts, 30).agg(F.sum("n"), F.count("*"), F.max("n")).first()[:] == (6, 900, 3)


def test_tags_become_columns(spark):
    scope = xy(spark, [(0.5, -0.5)] * 5)
    tags = table(spark, [("keep", 0), ("keep", 4), ("keep", 4), ("check", 2), ("keep", -3), (None, 1)], "tag string, ls_index long")
    got = {r["ls_index"]: (r["tag_keep"], r["tag_check"]) for r in J.tag_columns(scope, tags, ["keep", "check"]).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (False, True), 3: (False, False), 4: (True, False)}


def test_fingerprint_ignores_order_not_content(spark):
    df = xy(spark, [(0.1 * i, 0.2 * i) for i in range(50)]).withColumn("deleted", F.lit(False))
    a = A.scope_fingerprint(df).first()
    assert A.scope_fingerprint(df.repartition(7, "y")).first() == a
    assert A.scope_fingerprint(df.withColumn("x", F.when(F.col("ls_index") == 3, 9.0).otherwise(F.col("x")))).first() != a


# --- ranks under skew ------------------------------------------------------------------------


def test_running_in_group_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("ls_index"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 5).alias("w")
    )
    got = R.running_in_group(df, ["g"], ["ls_index"], "w").toPandas().sort_values("ls_index")
    ref = got.copy()
    assert (ref.groupby("g").cumcount() == ref["position"]).all()
    assert (ref.groupby("g")["w"].cumsum() == ref["running"]).all()


def test_assign_row_index_dense(spark):
    df = spark.range(1000).repartition(13).select(F.lit("same").alias("k"), "id")
    got = R.assign_row_index(df, [F.col("k")]).toPandas()
    assert sorted(got["ls_index"]) == list(range(1000)) and sorted(got["id"]) == list(range(1000))
    desc = R.assign_row_index(df, [F.col("id").desc()]).toPandas()
    assert (desc["ls_index"] + desc["id"] == 999).all()


def test_top_per_group_large_n(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    got = R.top_per_group(df, ["g"], ["v"], 1500).toPandas()
    assert sorted(got["v"]) == list(range(1500)) and (got["rank"] == got["v"] + 1).all()


@pytest.mark.parametrize("n", [10, 250])
def test_uniform_sample_exact(spark, n, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "ls_index")
    a = {r[0] for r in R.uniform_sample(df, n).collect()}
    monkeypatch.setattr(R, "DIRECT_SAMPLE", 5)  # the numbered way gives the same rows
    b = {r[0] for r in R.uniform_sample(df.repartition(9), n).collect()}
    assert len(a) == n and a == b


def test_sample_even_positions(spark):
    df = spark.range(25).select(F.lit("a").alias("g"), F.col("id").alias("ls_index")).union(
        spark.range(3).select(F.lit("b").alias("g"), F.col("id").alias("ls_index"))
    )
    got = R.sample_even(df, ["g"], ["ls_index"], 4).toPandas()
    assert sorted(got[got.g == "a"].ls_index) == [j * 25 // 4 for j in range(4)]
    assert len(got[got.g == "b"]) == 3


def test_sort_nulls_last(spark):
    df = table(spark, [(0, 2), (1, None), (2, 5)], "ls_index long, v int")
    assert [r["v"] for r in R.sort_rows(df, "v").collect()] == [2, 5, None]
    assert [r["v"] for r in R.sort_rows(df, "v", False).collect()] == [5, 2, None]


# --- clustering ------------------------------------------------------------------------------


def brute_dbscan(points, min_cluster, min_samples, eps):
    p = np.asarray(points, float)
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    comp = np.arange(len(p))
    while True:
        low = np.where(near & core[None] & core[:, None], comp[None], len(p)).min(1)
        nxt = np.where(core, np.minimum(comp, low), -1)
        if (nxt == comp).all():
            break
        comp = nxt
    out = np.full(len(p), -1)
    groups = sorted(((-(comp == c).sum(), c) for c in set(comp[core]) if (comp == c).sum() >= min_cluster))
    for i, (_, c) in enumerate(groups):
        out[comp == c] = i
    return out


def test_density_matches_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([
        rng.normal((0, 0), 0.05, (150, 2)), rng.normal((0.8, 0.5), 0.04, (120, 2)), rng.uniform(-1, 1, (80, 2)),
        np.tile([[0.3, -0.7]], (200, 1)), np.c_[np.linspace(-0.9, 0.9, 60), np.full(60, 0.95)],
    ])
    got = C.density_clusters(xy(spark, pts), 6, 4, 0.07).toPandas().sort_values("ls_index")["raw_cluster"].to_numpy()
    assert (got == brute_dbscan(pts, 6, 4, 0.07)).all()
    assert len(set(got)) > 3


def test_density_in_three_dimensions(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal((0, 0, 0), 0.05, (80, 3)), rng.normal((0.6, 0, 0.5), 0.05, (80, 3)), rng.uniform(-1, 1, (40, 3))])
    df = table(spark, [(i, *map(float, p)) for i, p in enumerate(pts)], "ls_index long, x double, y double, z double")
    got = C.density_clusters(df, 5, 4, 0.1).toPandas().sort_values("ls_index")["raw_cluster"].to_numpy()
    assert (got == brute_dbscan(pts, 5, 4, 0.1)).all()


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 4000)]
    nodes = sorted({n for e in edges for n in e} | {9999})
    got = C.connected_components(table(spark, edges, "a long, b long"), table(spark, [(n,) for n in nodes], "node long"))
    comp = {r["node"]: r["component"] for r in got.collect()}
    assert {comp[i] for i in range(201)} == {0} and {comp[i] for i in range(1000, 1300)} == {1000}
    assert comp[5000] == 4000 and comp[9999] == 9999


def test_graph_clusters_find_planted_topics(spark):
    rng = np.random.default_rng(5)
    base = np.eye(16)[:3]
    rows = [(i, (base[i // 40] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(120)]
    got = C.graph_clusters(table(spark, rows, "ls_index long, vector array<double>"), k=10).toPandas().set_index("ls_index")["raw_cluster"].sort_index()
    assert got.max() == 2
    for g in range(3):
        members = got.loc[g * 40 : g * 40 + 39]
        assert members[members >= 0].nunique() == 1 and (members < 0).sum() <= 2  # a row without mutual neighbours is noise


def test_hulls_of_square_with_copies(spark):
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    rng = np.random.default_rng(6)
    pts = corners + rng.uniform(0.1, 0.9, (300, 2)).tolist() + corners + [(0.5, 0.0)]
    df = xy(spark, pts).repartition(5).withColumn("raw_cluster", F.lit(0))
    line = xy(spark, [(0, 0), (1, 1), (2, 2)]).select((F.col("ls_index") + 1000).alias("ls_index"), "x", "y", F.lit(1).alias("raw_cluster"))
    got = C.cluster_hulls(df.unionByName(line)).orderBy("cluster", "pos").collect()
    assert [(r["cluster"], r["ls_index"]) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 3)]


def test_cluster_space_rules(spark):
    m, v = xy(spark, [(0, 0)]), table(spark, [(0, [1.0])], "ls_index long, vector array<double>")
    assert C.cluster_space("graph", "rows", m, v)[0] == "embedding"
    assert C.cluster_space("kmeans", "rows", m, v)[0] == "map"
    with pytest.raises(ValueError):
        C.cluster_space("graph", "tokens", m, v)
    with pytest.raises(ValueError):
        C.cluster_space("kmeans", "rows", m, None, "embedding")


# --- evaluation ------------------------------------------------------------------------------


def test_silhouette_by_hand(spark):
    df = xy(spark, [(0, 0), (0, 1), (10, 0), (10, 1), (50, 50)]).withColumn("cluster", F.least(F.floor(F.col("ls_index") / 2), F.lit(2)).cast("int"))
    p = np.array([(0, 0), (0, 1), (10, 0), (10, 1), (50, 50)], float)
    c = np.array([0, 0, 1, 1, 2])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    s = []
    for i in range(5):
        own = (c == c[i]).sum() - 1
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        a = d[i, c == c[i]].sum() / own if own else 0
        s.append(0 if own == 0 else (b - a) / max(a, b))
    assert E.silhouette(df).first()["silhouette"] == round(np.mean(s), 4)
    assert E.silhouette(df.withColumn("cluster", F.lit(0))).first()["silhouette"] is None


def test_agreement_limits(spark):
    a = table(spark, [(i, i % 3) for i in range(30)], "ls_index long, cluster int")
    same = E.agreement(a, a.select("ls_index", (F.col("cluster") + 5).alias("cluster"))).first()
    assert tuple(same) == (1.0, 1.0)
    assert E.changed_rows(a, a).count() == 0


def test_constant_displacement_is_zero(spark):
    m = xy(spark, [(i, 0) for i in range(5)])
    moved = m.withColumn("x", F.col("x") + 1)
    assert {r["score"] for r in E.map_displacement(m, moved).collect()} == {0.0}


# --- profile, labels, features, tokens, curation ----------------------------------------------


def test_profile_corners(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1.0D, 'http://a/b.png', X'89504E470D0A1A0A00', true, map('a', 1)), (double('inf'), 'http://a/c.JPG', NULL, false, map('b', 2)), "
        "(double('nan'), NULL, X'00', true, map('a', 1)) AS t(n, u, i, b, m)"
    )
    assert {r["column"]: r["type"] for r in PR.column_types(df).collect()} == {"n": "number", "u": "string", "i": "image", "b": "number", "m": "unknown"}
    ext = {r["column"]: (r["min"], r["max"]) for r in PR.number_extent(df).collect()}
    assert ext == {"n": (1.0, None), "b": (0.0, 1.0)}
    assert PR.url_flags(df).first()[:] == ("u", True, True)
    assert {r["column"]: r["unique"] for r in PR.unique_counts(df).collect()}["m"] == 2
    struct = df.select(F.struct(F.col("i").alias("bytes"), F.lit("p").alias("path")).alias("image"), F.lit("c").alias("caption"))
    assert {r["column"]: r["type"] for r in PR.column_types(struct).collect()}["image"] == "image"
    roles = {(r["role"], r["column"]) for r in PR.column_roles(struct).collect()}
    assert ("text", "caption") in roles


def test_too_many_categories(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    assert {r["column"] for r in PR.categories(df).collect()} == {"few"}


def test_token_labels(spark):
    names = {0: ["▁sea", "sea", "▁sea", "##port", "ĠĠbay", "##port", "▁", "sand", "sand", "sand"], 1: ["[SEP]"] * 3, 2: ["drift"] * 2}
    rows = [(c, -1 if c == 2 else c, s, -1 if s == "[SEP]" else 0) for c, all_ in names.items() for s in all_]
    tokens = table(spark, rows, "cluster int, raw_cluster int, token_str string, char_start int")
    got = {r["cluster"]: (r["label"], r["description"]) for r in L.token_labels(tokens).collect()}
    assert got == {
        0: ("sand, port, sea", "Token cluster 0 with 10 tokens; most frequent: sand, port, sea."),
        1: ("Cluster 1", "Token cluster 1 with 3 tokens."),
        2: ("Unclustered", "2 noise points the clustering algorithm did not assign to any cluster."),
    }
    assert {r["label"] for r in L.token_labels(tokens.drop("raw_cluster")).collect()} == {"sand, port, sea", "Cluster 1", "drift"}


def test_label_with_and_resume(spark):
    items = table(spark, [(0, 0, 0.2, "b"), (0, 1, 0.1, "a"), (1, 2, None, "z")], "cluster int, ls_index long, centroid_dist double, text string")
    got = {r["cluster"]: (r["label"], r["label_raw"]) for r in L.label_with(items, lambda t: "*" + " ".join(t), "text", skip=[1]).collect()}
    assert got == {0: ("a b", "*a b"), 1: ("Unclustered", "Unclustered")}


def test_feature_operators(spark):
    df = table(spark, [(0, [1, 2], [0.5, 0.0]), (1, [1, 3], [0.9, 0.05])], "ls_index long, top_indices array<int>, top_acts array<double>")
    s = {r["feature_id"]: tuple(r)[1:] for r in FE.feature_stats(df, 5).collect()}
    assert s[1] == (0.9, 2, 0.7) and s[2] == (0.0, 0, 0.0) and s[4] == (0.0, 0, 0.0)
    assert FE.alive_features(FE.feature_stats(df, 5)).first()[:] == (2, 3)
    assert [r["ls_index"] for r in FE.feature_search(df, 1, 0.1).collect()] == [1, 0]
    assert FE.feature_search(df, 1, 0.1, 1).count() == 1 and FE.feature_search(df, 3).count() == 0
    twice = table(spark, [(0, [3, 1, 3], [0.5, 0.0, 0.75])], "ls_index long, top_indices array<int>, top_acts array<double>")
    vec = twice.select(FE.sparse_vector(5).alias("v")).select("v.*", FE.dense_vector("v").alias("d")).first()
    assert vec[:] == (5, [1, 3], [0.0, 0.75], [0.0, 0.0, 0.0, 0.75, 0.0])


def test_encode_topk_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x, w, b = rng.normal(size=(60, 6)), rng.normal(size=(6, 64)), rng.normal(size=64)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "ls_index long, vector array<double>")
    got = FE.encode_topk(df, w, b, 4).toPandas().sort_values("ls_index")
    want = np.sort(np.maximum(x @ w + b, 0), axis=1)[:, ::-1][:, :4]
    assert np.allclose(np.stack(got["top_acts"]), want)


def test_token_counts_and_prefix(spark):
    docs = table(spark, [(0, "ab, cd!"), (1, None), (2, "é")], "ls_index long, text string")
    t = TK.tokenize(docs, "text", prefix="Q: ")
    got = {(r["ls_index"], r["token_pos"]): (r["token_str"], r["char_start"], r["char_end"]) for r in t.collect()}
    assert got[(0, 0)] == ("Q", -1, -1) and got[(0, 1)] == ("ab", 0, 2) and got[(0, 2)] == ("cd", 4, 6)
    assert got[(2, 1)] == ("é", 0, 1)
    counts = table(spark, [(0, 3), (1, 1), (2, 5)], "ls_index long, num_tokens int")
    assert TK.check_token_counts(counts, t).collect()[0][:] == (2, 5, 2)
    with pytest.raises(ValueError, match="2: 5 stored, 2 found"):
        TK.require_token_counts(counts, t)
    plain = TK.number_tokens(TK.tokenize(docs, "text", skip=["cd"])).orderBy("token_index").collect()
    assert [(r["token_index"], r["token_str"]) for r in plain] == [(0, "ab"), (1, "é")]


def test_replay_matches_sequential(spark):
    scope = table(spark, [(i, i % 3, f"Cluster {i % 3}", False) for i in range(12)], "ls_index long, cluster int, label string, deleted boolean")
    labels = scope.select("cluster", "label").distinct()
    log = [(0, "change_cluster", [1, 2, 3], 0, None), (1, "change_cluster_name", [], 0, "Zero"), (2, "delete_rows", [3, 4], None, None),
           (3, "change_cluster", [3], 2, None), (4, "change_cluster_name", [], 0, "Null"), (5, "change_cluster", [5], 0, None)]
    rows = {r["ls_index"]: dict(cluster=r["cluster"], label=r["label"], deleted=r["deleted"]) for r in scope.collect()}
    names = {r["cluster"]: r["label"] for r in labels.collect()}
    for _, action, ids, c, label in log:
        if action == "change_cluster":
            for i in ids:
                rows[i].update(cluster=c, label=names[c])
        elif action == "delete_rows":
            for i in ids:
                rows[i]["deleted"] = True
        else:
            names[c] = label
            for r in rows.values():
                if r["cluster"] == c:
                    r["label"] = label
    got = CU.replay(scope, labels, table(spark, log, "seq long, action string, ids array<long>, cluster int, label string"))
    assert {r["ls_index"]: dict(cluster=r["cluster"], label=r["label"], deleted=r["deleted"]) for r in got.collect()} == rows


def test_alignment_errors(spark):
    a, b = spark.range(5).withColumnRenamed("id", "ls_index"), spark.range(6).withColumnRenamed("id", "ls_index")
    J.aligned_tables_check(a, a)
    with pytest.raises(ValueError):
        J.aligned_tables_check(a, b)
    with pytest.raises(ValueError):
        J.same_granularity("rows", "tokens")


def test_unknown_filter_type_ignored(spark):
    df = table(spark, [(0, "abc"), (1, None)], "ls_index long, t string")
    assert FL.column_filter(df, [{"type": "nope", "column": "t", "value": 1}]).count() == 2
    assert FL.column_filter(df, [{"type": "contains", "column": "t", "value": "a.c"}]).count() == 1


def test_rare_labels_off_below_zero(spark):
    df = table(spark, [("a",), ("a",), ("b",)], "label string")
    fold = lambda t: sorted(r["folded"] for r in A.rare_label_fold(df, "label", t).collect())
    assert fold(2) == ["No Topic", "a", "a"] and fold(-1) == ["a", "a", "b"]


def test_graph_layout_separates_topics(spark):
    from embedmap.operators import layout as LY

    a, b = LY.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01
    rng = np.random.default_rng(8)
    base = np.eye(12)[:3]
    rows = [(i * 3, (base[i % 3] + rng.normal(scale=0.05, size=12)).tolist()) for i in range(90)]
    vectors = table(spark, rows, "ls_index long, vector array<double>")
    m = LY.graph_layout(vectors, P.project(vectors), k=8, epochs=5).toPandas().sort_values("ls_index")
    p = m[["x", "y"]].to_numpy()
    assert len(p) == 90 and abs(p).max() <= 1 + 1e-9
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + np.eye(90) * 9
    topic = np.arange(90) % 3
    near = np.argsort(d, axis=1)[:, :5]
    assert (topic[near] == topic[:, None]).mean() > 0.9


def test_fuzzy_graph_weights(spark):
    from embedmap.operators import layout as LY

    pts = [(0, [0.0]), (1, [1.0]), (2, [3.0]), (3, [7.0])]
    g = LY.fuzzy_graph(table(spark, pts, "ls_index long, vector array<double>"), 2, "euclidean").collect()
    assert {(r["a"], r["b"]) for r in g} >= {(0, 1), (1, 2)} and all(0 < r["w"] <= 1 for r in g)
    assert [r["w"] for r in g if (r["a"], r["b"]) == (0, 1)] == [1.0]


def test_graph_layout_query_uses_the_defaults(spark, monkeypatch):
    from embedmap.plans import mapping

    given = []
    monkeypatch.setattr(mapping.LY, "graph_layout", lambda *args, **more: given.append((len(args), more)))
    mapping.prj2(spark, "/root/testdata/sf0.001")
    assert given == [(2, {})]


def test_components_of_a_long_shuffled_path(spark):
    from embedmap.operators.cluster import connected_components

    order = np.random.default_rng(1).permutation(50_000).tolist()
    edges = table(spark, list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
    found = connected_components(edges, spark.range(50_000).withColumnRenamed("id", "node"))
    assert found.count() == 50_000 and [r.component for r in found.select("component").distinct().collect()] == [0]


def test_graph_layout_plans_do_not_grow_with_epochs(spark):
    from embedmap.operators import layout as LY

    pts = [(i, [float(i % 7), float(i // 7), 1.0]) for i in range(49)]
    v = table(spark, pts, "ls_index long, vector array<double>")
    out = LY.graph_layout(v, xy(spark, [(i % 7, i // 7) for i in range(49)]), k=4)
    size = int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a few joined tables of some kB each, however many epochs
    assert out.count() == 49 and size.bit_length() < 128

"""Neighbour descent against the exact join, and communities of planted topics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import communities as C
from embedmap.operators import descent as D
from embedmap.operators import layout as LY
from embedmap.operators import project as P
from embedmap.operators.knn import knn_join

SCHEMA = "ls_index long, vector array<double>, rank string"


def table(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "c") for i, v in zip(ids, m, strict=True)], SCHEMA)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_descent_finds_nearly_all_neighbours(spark, metric):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 24))[rng.integers(0, 40, 1500)] + rng.normal(scale=0.6, size=(1500, 24))
    v = table(spark, m)
    got = {(r.ls_index, r.neighbor): r.distance for r in D.neighbor_descent(v, 10, metric).collect()}
    want = {(r.ls_index, r.neighbor): r.distance for r in knn_join(v, v, 10, metric, include_self=False).collect()}
    assert len(got) == 15_000 and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-7 for p in got.keys() & want.keys())


def test_descent_with_many_copies_nulls_and_few_rows(spark):
    m = [[1.0, 0.0]] * 300 + [[0.0, 1.0], [0.0, 2.0], [1.0, 1.0], [0.0, 0.0], None]
    v = table(spark, m, range(10, 315))
    got = {}
    for r in D.neighbor_descent(v, 3).orderBy("ls_index", "rank").collect():
        got.setdefault(r.ls_index, []).append((r.neighbor, round(r.distance, 9)))
    assert len(got) == 303 and got[200] == [(10, 0.0), (11, 0.0), (12, 0.0)] and got[10] == [(11, 0.0), (12, 0.0), (13, 0.0)]
    assert got[310][0] == (311, 0.0) and got[310][1][0] == 312 and got[310][2] == (10, 1.0)
    assert D.neighbor_descent(table(spark, [[1.0, 2.0]]), 3).collect() == []
    assert D.neighbor_descent(table(spark, []), 3).collect() == []


def levels_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.level, {})[r.node] = r.community
    return out


def clique(nodes):
    return [(a, b, 1.0) for a in nodes for b in nodes if a < b]


def test_a_bridge_does_not_join_two_topics(spark):
    edges = clique(range(0, 12)) + clique(range(20, 32)) + [(5, 25, 1.0), (7, 7, 9.0), (3, None, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(12), *range(20, 32), 99]], "node long")
    got = levels_of(C.community_levels(spark.createDataFrame(edges, "a long, b long, w double"), nodes))
    for level in got.values():
        assert level == {i: 0 for i in range(12)} | {i: 20 for i in range(20, 32)} | {99: 99}


def test_levels_are_nested_and_modularity_rises(spark):
    # a ring of many small cliques: their pairs and more join on later levels
    edges = [e for g in range(40) for e in clique(range(5 * g, 5 * g + 5))] + [(5 * g, (5 * g + 6) % 200, 1.0) for g in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long, w double")
    got = levels_of(C.community_levels(frame, spark.range(200).withColumnRenamed("id", "node")))
    assert len(got) > 1 and all(len({got[0][5 * g + i] for i in range(5)}) == 1 for g in range(40))
    both = frame.union(frame.selectExpr("b", "a", "w"))
    rising = [C.modularity(both, spark.createDataFrame(list(got[x].items()), "node long, c long")) for x in sorted(got)]
    assert rising == sorted(rising) and rising[-1] > rising[0] > 0.5
    for low, high in zip(sorted(got), sorted(got)[1:], strict=False):
        inside = {}
        for node, c in got[low].items():
            inside.setdefault(c, set()).add(got[high][node])
        assert all(len(x) == 1 for x in inside.values())


def test_a_sweep_tells_the_modularity_it_began_with(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2)) if a < b}
    rows = [(a, b, 1.0 + a % 3) for a, b in pairs]
    both = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows] + [(99, 99, 4.0)], "a long, b long, w double")
    state = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node") % 7)
    m2 = both.agg(F.sum("w")).first()[0]
    got = C._moved(both, state, m2, 1.0, 0)
    r = got.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("total")).alias("kk")).first()
    assert (r.inside + 4.0) / m2 - r.kk / m2**2 == pytest.approx(C.modularity(both, state), abs=1e-12)
    assert got.count() == state.count() and C.modularity(both, got) > C.modularity(both, state)


def test_planted_topics(spark):
    rng = np.random.default_rng(3)
    topic = np.repeat(np.arange(4), 60)
    m = np.eye(16)[topic] + rng.normal(scale=0.12, size=(240, 16))
    got = {r.ls_index: r.raw_cluster for r in C.community_clusters(table(spark, m), k=10).collect()}
    shares = [max(np.bincount([got[i] for i in np.flatnonzero(topic == t) if got[i] >= 0])) / 60 for t in range(4)]
    assert len(got) == 240 and len(set(got.values()) - {-1}) == 4 and min(shares) > 0.9


def test_no_edges_and_no_nodes(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert levels_of(C.community_levels(none, spark.createDataFrame([(3,), (4,), (4,)], "node long"))) == {0: {3: 3, 4: 4}}
    assert C.community_clusters(table(spark, [])).collect() == []


def test_new_rows_go_to_their_topic_and_old_ones_stay(spark):
    rng = np.random.default_rng(4)
    topic = np.arange(180) % 3
    m = np.eye(8)[topic] + rng.normal(scale=0.1, size=(180, 8))
    # new rows lie between two topics, and their neighbours come from both
    new = 0.52 * np.eye(8)[:3] + 0.48 * np.eye(8)[[1, 2, 0]]
    centers = np.array([[-0.8, -0.8], [0.8, -0.8], [0.0, 0.9]])
    xy = centers[topic] + rng.normal(scale=0.03, size=(180, 2))
    old_map = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "ls_index long, x double, y double")
    old, more = table(spark, m), table(spark, [*new, m[0]], [900, 901, 902, 5])
    got = {r.ls_index: (r.x, r.y) for r in LY.place_by_layout(old_map, old, more, k=30).collect()}
    assert len(got) == 183 and all(got[i] == tuple(xy[i]) for i in range(180))
    mean = {r.ls_index: (r.x, r.y) for r in P.place_new_rows(old_map, old, more.filter("ls_index >= 900"), 30).collect()}
    # how near the nearer half of a row's 30 nearest old rows lies on the map
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    far = {}
    for name, placed in (("layout", got), ("mean", mean)):
        near = [np.argsort(-unit @ v, kind="stable")[:30] for v in new]
        far[name] = [np.sort(np.linalg.norm(xy[n] - placed[900 + t], axis=1))[:15].mean() for t, n in enumerate(near)]
    assert np.mean(far["layout"]) < 0.8 * np.mean(far["mean"])


def test_a_ready_neighbour_table_is_used(spark):
    from embedmap.operators.cluster import graph_clusters

    rng = np.random.default_rng(6)
    v = table(spark, np.eye(6)[np.arange(90) % 3] + rng.normal(scale=0.05, size=(90, 6)))
    near = D.neighbor_descent(v, 6)
    for found in (graph_clusters(v, 6, near=near), C.community_clusters(v, 6, near=near, resolution=0.5)):
        by = {}
        for r in found.collect():
            by.setdefault(r.raw_cluster, set()).add(r.ls_index % 3)
        assert all(len(x) == 1 for c, x in by.items() if c >= 0)
    assert LY.fuzzy_graph(v, 6, near=near).count() == LY.fuzzy_graph(v, 6).count()


def test_entry_met_again_is_not_new(spark):
    found = spark.createDataFrame([(1, 2, 0.5, 1), (1, 2, 0.5, 0), (1, 3, 0.7, 0)], "ls_index long, neighbor long, distance double, old int")
    assert [(r.neighbor, r.old) for r in D._lists(found, 5).orderBy("rank").collect()] == [(2, 1), (3, 0)]


def test_compact_vectors_lose_nothing(spark):
    for rows, kind in (([[0.5, 1.25], [3.0, -4.0]], "array<float>"), ([[0.1, 0.2], [3.0, -4.0]], "array<double>")):
        got = D._compact(table(spark, rows), table(spark, rows), "vector", True)
        assert got.schema["v"].dataType.simpleString() == kind
        for r in got.collect():
            assert [x / r.s for x in r.v] == [x / np.sqrt(np.square(rows[r.ls_index]).sum()) for x in rows[r.ls_index]]


def test_pairs_of_many_centers_leave_together():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    m = rng.normal(size=(9, 6))
    groups = [[0, 1, 2, 3], [4], [5, 6, 7, 8, 0]]
    ends, old = rng.uniform(2, 4, 9), rng.integers(0, 2, 9)
    pick = lambda x: [[x[i] for i in g] for g in groups]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
    columns = (list(range(9)), (m * 2.0).tolist(), [2.0] * 9, ends.tolist(), old.tolist())
    whole = pa.RecordBatch.from_arrays([pa.array(pick(c), t) for c, t in zip(columns, kinds)], names=["ids", "vs", "ss", "ends", "old"])
    for part, some in ((whole, groups), (whole.slice(1), groups[1:])):
        want = {(a, b) for g in some for a in g for b in g if a != b and np.linalg.norm(m[a] - m[b]) < ends[a] and not (old[a] and old[b])}
        got = D._nearer(part, False)
        assert want and set(zip(got.column("ls_index").to_pylist(), got.column("neighbor").to_pylist())) == want
        assert got.column("distance").to_pylist() == pytest.approx([np.linalg.norm(m[a] - m[b]) for a, b in zip(got.column("ls_index").to_pylist(), got.column("neighbor").to_pylist())])

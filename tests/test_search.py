"""Vector search against brute force, with copies and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import knn as K
from embedmap.operators import quantized as Q
from embedmap.operators import search as S


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "ls_index long, vector array<double>")


def brute(left, right, k, cosine=False, self_ok=True):
    out = {}
    for i, a in enumerate(left):
        if cosine:
            d = 1 - right @ a / (np.linalg.norm(right, axis=1) * np.linalg.norm(a))
        else:
            d = np.sqrt(((right - a) ** 2).sum(1))
        order = sorted(range(len(right)), key=lambda j: (round(d[j], 9), j))
        order = [j for j in order if self_ok or j != i][:k]
        out[i] = [(j, round(float(d[j]), 6)) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("ls_index", "rank").collect():
        out.setdefault(r["ls_index"], []).append((r["neighbor"], round(r["distance"], 6) + 0.0))
    return out


@pytest.mark.parametrize("self_ok", [True, False])
def test_knn_map_with_hot_copies_and_grid_ties(spark, self_ok, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(0)
    pts = np.vstack([
        rng.normal(0, 0.2, (300, 2)), np.tile([[0.5, 0.5]], (200, 1)),
        np.array([(a, b) for a in range(6) for b in range(6)]) / 4.0,
    ])
    got = lists(K.knn_join(frame(spark, pts), frame(spark, pts), 7, include_self=self_ok))
    assert got == brute(pts, pts, 7, self_ok=self_ok)


def test_knn_cosine_high_dimensions(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(250, 24))
    m[200:] = m[:50] * 2.0
    q = rng.normal(size=(40, 24))
    got = lists(K.knn_join(frame(spark, q), frame(spark, m), 5, "cosine"))
    want = brute(q, m, 5, cosine=True)
    assert {k: [d for _, d in v] for k, v in got.items()} == {k: [d for _, d in v] for k, v in want.items()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_in_many_dimensions_sends_a_row_a_fixed_number_of_times(spark, metric, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(600, 20)) * (1.0 if metric == "cosine" else 1e3) + (0.0 if metric == "cosine" else 1e4)
    m[500:] = m[:100]
    m[590:] = m[7]
    sent = []
    pairs = K._wide_parts
    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    monkeypatch.setattr(K, "_wide_parts", lambda rows, dims: sent.append(pairs(rows, dims)) or sent[-1])
    got = lists(K.knn_join(frame(spark, m), frame(spark, m), 9, metric, include_self=False))
    assert sent == [8, 8] and pairs(500_000, 64) == 8 and pairs(10, 64) == 1 and pairs(5_000_000, 64) == 39
    want = brute(m, m, 9, cosine=metric == "cosine", self_ok=False)
    assert {k: [round(d, 5) for _, d in v] for k, v in got.items()} == {k: [round(d, 5) for _, d in v] for k, v in want.items()}


def test_wide_pairs_equal_the_plain_ones(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    for scale in (1.0, 1e-20, 1e200**0.5):
        a, b = rng.normal(size=(700, 18)) * scale, rng.normal(size=(900, 18)) * scale
        b[300:500] = b[0]
        a[3] = b[0]
        ids = rng.permutation(len(b))
        got, want = ([np.concatenate(x) for x in zip(*f(a, b, 6, False, ids), strict=True)] for f in (K._wide_pairs, K.best_pairs))
        if scale == 1.0:
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert len(got[2]) == len(want[2]) and np.allclose(got[2], want[2], rtol=1e-9, atol=0.0 if scale > 1 else 1e-9)


def test_knn_fewer_rows_than_k_and_zero_vectors(spark):
    pts = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    assert lists(K.knn_join(frame(spark, pts), frame(spark, pts), 5)) == brute(pts, pts, 5)
    got = lists(K.knn_join(frame(spark, pts), frame(spark, pts), 5, "cosine"))
    assert set(got) == {1, 2} and all(j != 0 for v in got.values() for j, _ in v)
    assert K.knn_join(frame(spark, pts), frame(spark, pts).filter("ls_index > 9"), 2).count() == 0


def test_knn_all_equal(spark):
    pts = np.zeros((50, 2))
    assert lists(K.knn_join(frame(spark, pts), frame(spark, pts), 3)) == brute(pts, pts, 3)


def test_nn_search_orders_ties_by_id(spark):
    m = np.array([[1, 0], [0, 1], [2, 0], [1, 1], [0, 0]], float)
    got = [(r[0], round(r[1], 6)) for r in S.nn_search(frame(spark, m), [1.0, 0.0]).collect()]
    assert got == [(0, 0.0), (2, 0.0), (3, 0.292893), (1, 1.0)]
    only = frame(spark, m).filter("ls_index IN (1, 3)")
    assert [r[0] for r in S.nn_search(frame(spark, m), [1.0, 0.0], scope=only).collect()] == [3, 1]


def test_batch_search_does_not_depend_on_the_number_of_queries(spark):
    rng = np.random.default_rng(2)
    m, q = rng.normal(size=(200, 6)), rng.normal(size=(1500, 6))
    m[[3, 77]] = 0
    q[[2, 900]] = 0  # no direction: found by nothing, finds nothing
    asks = frame(spark, q).withColumnRenamed("ls_index", "query")
    found = lambda a: {(r["query"], r["rank"]): (r["ls_index"], round(r["distance"], 9)) for r in S.batch_search(a, frame(spark, m), 4).collect()}
    few, many = found(asks.filter("query < 5")), found(asks)
    assert few == {k: v for k, v in many.items() if k[0] < 5}
    assert len(few) == 16 and len(many) == 4 * 1498
    assert not {3, 77} & {i for i, _ in many.values()}


def test_ties_stay_in_the_task(spark):
    same = np.tile([1.0, 2.0], (5000, 1))
    at, col, dist = (np.concatenate(x) for x in zip(*K.best_pairs(same[:3], same, 10, True, np.arange(5000)[::-1].copy()), strict=True))
    assert len(at) == 30 and set(col[at == 0]) == set(range(4990, 5000)) and np.allclose(dist, -4.0)
    got = S.nn_search(frame(spark, same), [3.0, 1.0], 10).collect()
    assert [r["ls_index"] for r in got] == list(range(10))


def axis(i, dim=12):
    return [float(j == i) for j in range(dim)]


def test_maxsim_counts_the_best_token_of_each_query_token(spark):
    """Documents that hold 3, 2, 1 and none of the query's directions, one of them twice."""
    held = {5: [0, 1, 2, 9], 2: [1, 2, 8], 8: [2, 2, 7], 1: [6, 7]}
    docs = spark.createDataFrame([(i, [axis(a) for a in t]) for i, t in held.items()], "ls_index long, token_vectors array<array<double>>")
    got = [(r[0], round(r[1], 4)) for r in S.maxsim([axis(a) for a in (0, 1, 2)], docs).collect()]
    assert got == [(5, 3.0), (2, 2.0), (8, 1.0), (1, 0.0)]


def test_late_interaction_looks_at_every_document(spark):
    """A match that the mean vectors hide, far beyond any number of candidates."""
    rng = np.random.default_rng(11)
    tokens = rng.normal(size=(900, 3, 12))
    tokens[..., 4] = 0
    tokens[611, 2] = axis(4)
    docs = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tokens)], "ls_index long, token_vectors array<array<double>>")
    means = tokens.mean(1)
    means[611, 4] = 0
    full = S.late_interaction_search([axis(4)], frame(spark, means), docs, final=2).collect()
    assert full[0]["ls_index"] == 611 and abs(full[0]["score"] - 1) < 1e-9 and len(full) == 2
    some = S.late_interaction_search([axis(4)], frame(spark, means), docs, prefilter=20, final=900).count()
    assert some <= 40


def test_ivf_index_lives_on_and_grows(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    m = np.vstack([c + rng.normal(scale=0.3, size=(30, 16)) for c in centers])
    m[7] = 0
    q = np.vstack([m[::60], np.zeros((1, 16))])
    asks = frame(spark, q).withColumnRenamed("ls_index", "query")
    key = lambda df: {(r["query"], r["rank"]): r["ls_index"] for r in df.collect()}
    exact = key(S.batch_search(asks, frame(spark, m), 50))
    path = f"{tmp_path}/index"
    built = S.ivf_build(frame(spark, m).filter("ls_index < 400"), nlist=20, path=path)
    assert built.sizes.sum() == 399
    index = S.ivf_append(S.ivf_open(spark, path), frame(spark, m).filter("ls_index >= 400"))
    assert index.sizes.sum() == 599
    assert key(S.ivf_search(asks, index, 50, nprobe=20)) == exact
    # one cell holds fewer rows than asked for, so more are probed until there are enough
    near = key(S.ivf_search(asks, index, 50, nprobe=1))
    assert set(near) == set(exact)
    hits = {(k[0], v) for k, v in near.items()} & {(k[0], v) for k, v in exact.items()}
    assert len(hits) >= 0.6 * len(exact)
    # more queries than travel with tasks, same rows for those shared
    many = frame(spark, np.vstack([q, rng.normal(size=(1500, 16))])).withColumnRenamed("ls_index", "query")
    again = key(S.ivf_search(many, index, 50, nprobe=1))
    assert near == {k: v for k, v in again.items() if k[0] < len(q)}


def test_quantised_index_finds_and_grows(spark, tmp_path):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 20))
    m = np.vstack([c + rng.normal(scale=0.4, size=(60, 20)) for c in centers] + [np.repeat(centers[:1], 300, axis=0)])
    m[11] = 0
    q = np.vstack([m[5:700:35], np.zeros((1, 20))])
    asks = frame(spark, q).withColumnRenamed("ls_index", "query").union(spark.createDataFrame([(99, None)], "query long, vector array<double>"))
    rows = frame(spark, m)
    path = f"{tmp_path}/pq"
    built = Q.pq_build(rows.filter("ls_index < 800"), nlist=12, subspaces=8, path=path)
    assert built.books.shape[0] == 8 and built.books.shape[2] == 3 and built.codes.count() == 799
    index = Q.pq_append(Q.pq_open(spark, path), rows.filter("ls_index >= 800"))
    assert index.codes.count() == len(m) - 1 == index.codes.select("ls_index").distinct().count()
    exact = {(r["query"], r["rank"]): r for r in S.batch_search(asks.filter("vector IS NOT NULL"), rows, 10).collect()}
    got = {(r["query"], r["rank"]): r for r in Q.pq_search(asks, index, 10, nprobe=4).collect()}
    assert set(got) == set(exact) and not {k for k in got if k[0] in (len(q) - 1, 99)}
    hits = sum(r["distance"] <= exact[k[0], 10]["distance"] + 1e-6 for k, r in got.items())
    assert hits >= 0.9 * len(exact)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for k, r in got.items():
        assert r["distance"] == pytest.approx(1 - unit[r["ls_index"]] @ (q[k[0]] / np.linalg.norm(q[k[0]])), abs=1e-6)
    # with the whole probed cells on the shortlist the codes choose nothing: same rows as an exact search of these cells
    all_in = {(r["query"], r["rank"]): r["ls_index"] for r in Q.pq_search(asks, index, 10, nprobe=12, rerank=200).collect()}
    assert all_in == {k: r["ls_index"] for k, r in exact.items()}


def test_neighbors_clamped_to_map(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 3.0, 0.0)], "ls_index long, x double, y double")
    assert [r[0] for r in S.neighbors_of(pts, 1, 10).collect()] == [0, 2]
    near = S.closest_on_map(pts.withColumn("x", F.col("x") / 100), 0.0, 0.0).collect()
    assert [r[0] for r in near] == [0, 1, 2]


def test_each_pair_of_blocks_is_a_task_of_its_own(spark):
    m = np.random.default_rng(9).normal(size=(400, 20))
    left = frame(spark, m).selectExpr("cast(ls_index as long) AS ls_index", "vector AS v")
    right = left.selectExpr("array(ls_index) AS ids", "v")
    at = K._dealt(left, 3, right, 5).withColumn("task", F.spark_partition_id())
    pairs = at.groupBy("task").agg(F.count_distinct("pair").alias("pairs"), F.count_if("asks").alias("n")).collect()
    assert len(pairs) == 15 and all(r.pairs == 1 for r in pairs) and sum(r.n for r in pairs) == 5 * 400

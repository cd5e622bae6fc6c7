import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import evaluate as E
from embedmap.operators import farfield as FF
from embedmap.operators import sparse_svd as SV


def _points(spark, p, c):
    names = ["x", "y", "z"][: p.shape[1]]
    rows = [(i, int(k), *map(float, v)) for i, (v, k) in enumerate(zip(p, c, strict=True))]
    return spark.createDataFrame(rows, "ls_index long, cluster int, " + ", ".join(f"{n} double" for n in names))


def _score(p, c):
    # exact score in one matrix, as plain as it can be
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    sums = np.stack([d[:, c == k].sum(1) for k in np.unique(c)], 1)
    n = np.bincount(c)
    own = np.arange(len(p)), c
    a = sums[own] / np.maximum(n[c] - 1, 1)
    means = sums / n
    means[own] = np.inf
    b = means.min(1)
    return float(np.where(n[c] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("leaf", [4, 64])
def test_far_sums_keep_the_score(spark, dims, leaf):
    rng = np.random.default_rng(dims)
    n = 1500 if dims == 2 else 500
    c = rng.integers(0, 5, n)
    p = rng.normal(size=(5, dims))[c] * 2 + rng.normal(size=(n, dims)) * np.array([0.05, 0.3, 0.6, 1.0, 0.01])[c][:, None]
    # a third of the rows on one place, of two clusters
    p[: n // 3], c[: n // 3] = p[0], np.arange(n // 3) % 2
    got = FF.silhouette_far(_points(spark, p, c), leaf=leaf).first()
    assert got["scored"] == n and abs(got["silhouette"] - _score(p, c)) <= 1e-3


def test_far_cells_are_really_used(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = rng.integers(0, 3, 900)
    p = rng.uniform(size=(900, 2)) + c[:, None]
    compared = []
    plain = FF._near_sums
    monkeypatch.setattr(FF, "_near_sums", lambda pairs, axes: (compared.append(pairs.agg(F.sum(F.size("left") * F.size("right"))).first()[0]), plain(pairs, axes))[1])
    got = FF.silhouette_far(_points(spark, p, c), tolerance=0.02, leaf=2).first()["silhouette"]
    assert sum(compared) < 900 * 900 / 4
    assert abs(got - _score(p, c)) <= 0.02


def test_few_places_are_compared_in_one_list(spark, monkeypatch):
    rng = np.random.default_rng(6)
    c, p = rng.integers(0, 3, 1000), rng.normal(size=(1000, 3))
    lists = []
    plain = FF._near_sums
    monkeypatch.setattr(FF, "_near_sums", lambda pairs, axes: (lists.append(pairs.count()), plain(pairs, axes))[1])
    got = FF.silhouette_far(_points(spark, p, c)).first()["silhouette"]
    assert lists == [1]
    assert abs(got - _score(p, c)) <= 1e-4


def test_far_sums_of_odd_tables(spark):
    one = _points(spark, np.zeros((4, 2)), np.zeros(4, int))
    assert FF.silhouette_far(one).first()["silhouette"] is None
    assert FF.silhouette_far(one.limit(0)).first().asDict() == {"silhouette": None, "scored": 0}
    same = _points(spark, np.zeros((6, 2)), np.arange(6) % 2)
    assert FF.silhouette_far(same).first()["silhouette"] == E.silhouette(same).first()["silhouette"] == 0.0
    gap = _points(spark, np.array([[0.0, 0], [0, 1], [9, 0], [9, 1]]), np.array([0, 0, 1, 1]))
    holes = gap.union(spark.sql("SELECT 9L, CAST(NULL AS INT), 0D, 0D UNION ALL SELECT 10L, 1, NULL, 0D"))
    assert FF.silhouette_far(holes).first()["silhouette"] == E.silhouette(gap).first()["silhouette"]


def _features(spark, m):
    rows = [(i, [int(j) for j in np.nonzero(r)[0]], [float(r[j]) for j in np.nonzero(r)[0]]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "ls_index long, top_indices array<int>, top_acts array<double>")


def test_subspace_equals_the_covariance(spark):
    rng = np.random.default_rng(3)
    # three planted directions over sparse rows, and one feature in nearly all of them
    m = np.maximum(rng.normal(size=(400, 3)) @ rng.normal(size=(3, 30)) + 0.3 * rng.normal(size=(400, 30)), 0) * (rng.random((400, 30)) < 0.4)
    m[:, 7] = 1 + rng.random(400)
    m[:, 11] = 0
    entries = SV.unit_entries(_features(spark, m), 30)
    # second moments of the features by a plain join of the entries
    pair = entries.alias("a").join(entries.alias("b"), "ls_index").groupBy("a.feature_id", "b.feature_id").agg(F.sum(F.col("a.act") * F.col("b.act")))
    cov = np.zeros((30, 30))
    for i, j, v in pair.collect():
        cov[i, j] = v
    values, vectors = np.linalg.eigh(cov)
    got, found = SV.sparse_svd(entries, 3, oversample=8, rounds=40, tolerance=1e-9)
    rows = {r.feature_id: r.q for r in got.collect()}
    assert sorted(rows) == [i for i in range(30) if i != 11]
    q = np.array([rows.get(i, [0.0] * 3) for i in range(30)])
    assert np.allclose(np.array(found) ** 2, values[::-1][:3], rtol=1e-6)
    assert np.allclose(q.T @ q, np.eye(3), atol=1e-8)
    assert np.linalg.svd(vectors[:, ::-1][:, :3].T @ q)[1].min() > 1 - 1e-4


def test_feature_map_of_few_features(spark):
    m = np.zeros((5, 3))
    m[:, 0], m[2, 1] = 1.0, 4.0
    got = SV.sparse_feature_map(_features(spark, m), 3).collect()
    assert sorted(r.feature_id for r in got) == [0, 1]
    assert SV.sparse_feature_map(_features(spark, m).limit(0), 3).collect() == []


def test_sparse_svd_ends_when_the_vectors_are_steady(spark):
    # values that lie close together: a value settles long before its vector does
    rng = np.random.default_rng(3)
    m = np.where(rng.random((900, 300)) < 0.05, rng.random((900, 300)), 0.0)
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    entries = spark.createDataFrame(rows, "ls_index long, feature_id long, act double")
    got, found = SV.sparse_svd(entries, 3)
    q = np.zeros((300, 3))
    for r in got.collect():
        q[r["feature_id"]] = r["q"]
    want = np.linalg.svd(m, compute_uv=False)[:3]
    assert np.allclose(found, want, rtol=1e-8)
    assert np.allclose(q.T @ q, np.eye(3), atol=1e-8)
    assert np.linalg.norm(m.T @ (m @ q) - q * want**2, axis=0).max() < 1e-4 * want[2] ** 2


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("leaf", [4, 64])
def test_cells_of_two_ancestors_go_together(spark, monkeypatch, dims, leaf):
    rng = np.random.default_rng(dims)
    c = rng.integers(0, 5, 600)
    p = rng.normal(size=(5, dims))[c] * 2 + rng.normal(size=(600, dims)) * 0.5
    p[:200], c[:200] = p[0], np.arange(200) % 2
    lists, plain = [], FF._family_sums
    monkeypatch.setattr(FF, "FAMILY_WORK", 0)
    monkeypatch.setattr(FF, "_near_sums", None)
    monkeypatch.setattr(FF, "_family_sums", lambda pairs, axes: (lists.append(pairs.agg(F.count("*"), F.sum(F.size("met"))).first()), plain(pairs, axes))[1])
    got = FF.silhouette_far(_points(spark, p, c), leaf=leaf).first()["silhouette"]
    assert abs(got - _score(p, c)) <= 1e-3
    # fewer lists travel than cells meet, but for one ancestor
    assert any(n < m / 2 for n, m in lists) or leaf == 64


def test_distance_sums_in_tiles():
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(3, 200)), rng.normal(size=(3, 3000))
    first, n = np.array([0, 1, 900, 1024, 2500]), rng.integers(1, 4, 3000)
    d = np.sqrt(((left[:, :, None] - right[:, None]) ** 2).sum(0))
    for weight in (None, n):
        want = np.add.reduceat(d if weight is None else d * weight, first, axis=1)
        assert np.allclose(E.distance_sums([*left], [*right], weight, first), want, rtol=1e-12)


def test_blocks_of_the_exact_score_leave_one_sum_a_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    c, p = rng.integers(0, 4, 300), rng.normal(size=(300, 2))
    for name, value in (("MEAN_BLOCK", 16), ("SCORE_PARTS", 3), ("SCORE_ROWS", 64)):
        monkeypatch.setattr(E, name, value)
    df = _points(spark, p, c)
    assert abs(E.silhouette(df).first()["silhouette"] - _score(p, c)) <= 1e-4
    # a row without a cluster has no score, and none counts it
    odd = df.union(spark.createDataFrame([(300, None, 0.0, 0.0)], df.schema))
    assert E.silhouette(odd).first().asDict() == {"silhouette": None, "scored": 301}

import numpy as np
from pyspark.sql import functions as F

from embedmap.operators.aligned import aligned_layouts
from embedmap.operators.layout import curve, graph_layout, run_epochs
from embedmap.operators.project import align_layouts, normalize_frame, project


def _frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "ls_index long, vector array<double>")


def _maps(df, n):
    out = np.zeros((3, n, 2))
    for r in df.collect():
        out[r.window, r.ls_index] = r.x, r.y
    return out


def _kept(maps, windows, k=8):
    """Share of the nearest vectors that are nearest on the map."""
    total = 0.0
    for p, m in zip(maps, windows, strict=True):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        near = lambda d: np.argsort(d + np.eye(len(d)) * 1e9, axis=1)[:, :k]
        a, b = near(1 - u @ u.T), near(((p[:, None] - p[None]) ** 2).sum(2))
        total += np.mean([len(set(x) & set(y)) / k for x, y in zip(a, b, strict=True)])
    return total / 3


def test_windows_stay_together(spark):
    rng = np.random.default_rng(2)
    n = 60
    topic = np.arange(n) % 4
    base = rng.normal(size=(4, 12))[topic] * 2 + rng.normal(size=(n, 12)) * 0.4
    drift = rng.normal(size=(2, 4, 12))
    windows = [base, base + 0.7 * drift[0][topic], base + 0.7 * drift[0][topic] + 0.7 * drift[1][topic]]
    frames = [_frame(spark, m) for m in windows]
    joint = _maps(aligned_layouts(frames, k=8, epochs=10), n)
    chain = align_layouts([graph_layout(f, project(f), k=8, epochs=10) for f in frames])
    chain = _maps(normalize_frame(chain, ["x", "y"]), n)
    moved = lambda m: np.sqrt(((m[1:] - m[:-1]) ** 2).sum(2)).sum()
    assert moved(joint) < 0.7 * moved(chain)
    assert _kept(joint, windows) >= _kept(chain, windows) - 0.05
    assert abs(joint).max() <= 1 + 1e-9


def test_windows_of_different_rows(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(20, 6))
    first, second = _frame(spark, m).filter("ls_index < 15"), _frame(spark, m).filter("ls_index >= 5")
    got = aligned_layouts([first, second], k=4, epochs=2)
    assert {(r.window, r["count"]) for r in got.groupBy("window").count().collect()} == {(0, 15), (1, 15)}
    assert got.filter(F.isnan("x") | F.isnan("y")).count() == 0


def _by_hand(xy, deg, links, epochs, repel, partners):
    a, b = curve(0.1)
    for epoch in range(epochs):
        force = np.zeros((len(xy), 3))
        for i, j, w, twin in links:
            d = xy[i] - xy[j]
            d2 = float(d @ d)
            stiff = w * (max(deg[i], 0.03) if twin else 2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))
            force[i] += [*(-stiff * d), stiff]
        for i, s in np.ndindex(len(xy), repel):
            j = partners[epoch, i, s + 1]
            if j != i:
                d = xy[i] - xy[j]
                d2 = float(d @ d)
                force[i, :2] += deg[i] * np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * d, -4, 4)
        xy = xy + (1 - epoch / epochs) * np.clip(force[:, :2] / (force[:, 2:] + 0.03), -4, 4)
    return xy


def test_epochs_in_blocks_give_the_forces_of_all_edges(spark):
    rng = np.random.default_rng(5)
    xy, deg = rng.normal(size=(12, 2)) * 3, np.zeros(12)
    pairs = [(0, 1, 1.0), (1, 2, 0.5), (2, 5, 0.25), (3, 4, 1.0), (0, 11, 0.75), (6, 7, 0.5)]
    links = [(i, j, w, False) for a, b, w in pairs for i, j in ((a, b), (b, a))] + [(8, 9, 0.5, True), (9, 8, 0.5, True), (1, 9, 0.5, True)]
    for i, _, w, twin in links:
        deg[i] += 0.0 if twin else w
    # partners among the first eight or the last four rows
    first, rows = [0] * 8 + [8] * 4, [8] * 8 + [4] * 4
    state = spark.createDataFrame([(i, *map(float, xy[i]), float(deg[i]), first[i], rows[i]) for i in range(12)], "p long, x double, y double, deg double, first long, rows long")
    each = state.crossJoin(spark.sql("SELECT e, s FROM VALUES (0), (1), (2) t(e), VALUES (1), (2) u(s)"))
    each = each.select("e", "p", "s", (F.col("first") + F.pmod(F.xxhash64("p", "e", "s"), F.col("rows"))).alias("j")).collect()
    expected = _by_hand(xy, deg, links, 3, 2, {(r.e, r.p, r.s): r.j for r in each})
    edges = spark.createDataFrame(links, "i long, j long, w double, twin boolean")
    for blocks in (1, 3, 5):
        got = run_epochs(state, edges, 12, 3, 0.1, 2, blocks).orderBy("p").collect()
        assert np.allclose([(r.x, r.y) for r in got], expected, atol=1e-9)

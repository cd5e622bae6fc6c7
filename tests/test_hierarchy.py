"""Hierarchical density clusters against a direct computation on all thresholds."""

import numpy as np
import pytest

from embedmap.operators import hierarchy as H

SCHEMA = "ls_index long, x double, y double, cluster string"


def brute(pts, least, samples, k):
    """Clusters as sets of row positions, by looking at the components of every threshold."""
    places = sorted(set(map(tuple, pts)))
    weight = [sum(tuple(p) == q for p in pts) for q in places]
    xy = np.array(places)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    first = [min(i for i, p in enumerate(pts) if tuple(p) == q) for q in places]
    core, near = [], []
    for i in range(len(places)):
        order = sorted((j for j in range(len(places)) if j != i), key=lambda j: (d[i, j], first[j]))[:k]
        near.append(order)
        total, radius = weight[i], 0.0 if weight[i] >= samples else None
        for j in order:
            total += weight[j]
            if radius is None and total >= samples:
                radius = d[i, j]
        core.append(radius)
    edges = {(min(i, j), max(i, j)): max(d[i, j], core[i], core[j]) for i in range(len(places)) for j in near[i] if core[i] is not None and core[j] is not None}

    def components(limit):
        label = list(range(len(places)))
        changed = True
        while changed:
            changed = False
            for (i, j), w in edges.items():
                if w <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        groups = {}
        for i, g in enumerate(label):
            groups.setdefault(g, set()).add(i)
        return [frozenset(g) for g in groups.values()]

    size = lambda g: sum(weight[i] for i in g)
    dens = lambda w: 1 / max(w, H.LEAST)
    # nodes: [parts, start, points that joined with their weights]; live: big component -> node
    nodes, live, joined = [], {}, set()
    for w in [0.0, *sorted(set(edges.values()))]:
        new = {}
        for g in components(w):
            if size(g) < least:
                continue
            inside = [node for part, node in live.items() if part <= g]
            if len(inside) == 1:
                node = inside[0]
            else:
                nodes.append([inside, w, []])
                node = len(nodes) - 1
            for i in g - joined:
                nodes[node][2].append((i, w))
            joined |= g
            new[g] = node
        live = new
    up = {c: n for n, (parts, _, _) in enumerate(nodes) for c in parts}
    members = {}
    best, sets = {}, {}
    for n, (parts, start, points) in enumerate(nodes):
        held = set().union(*[members[c] for c in parts]) if parts else set()
        members[n] = held | {i for i, _ in points}
        birth = dens(nodes[up[n]][1]) if n in up else 0.0
        mass = sum(weight[i] * (dens(w) - birth) for i, w in points) + size(held) * (dens(start) - birth)
        below = sum(best[c] for c in parts)
        whole = n not in up and sum(c not in up for c in range(len(nodes))) == 1
        sets[n] = [n] if mass >= below and not whole else [x for c in parts for x in sets[c]]
        best[n] = max(mass, below)
    chosen = [x for n in sets if n not in up for x in sets[n]]
    return {frozenset(i for i, p in enumerate(pts) if places.index(tuple(p)) in members[n]) for n in chosen}


def found(spark, pts, **more):
    rows = [(i, float(x), float(y), "c") for i, (x, y) in enumerate(pts)]
    out = {}
    for r in H.hierarchical_clusters(spark.createDataFrame(rows, SCHEMA), **more).collect():
        out.setdefault(r.raw_cluster, set()).add(r.ls_index)
    assert sum(map(len, out.values())) == len(pts)
    return out


def blobs(seed):
    rng = np.random.default_rng(seed)
    dense, wide = rng.normal([0, 0], 0.02, (60, 2)), rng.normal([1.2, 0], 0.15, (50, 2))
    second, dust = rng.normal([0.15, 0.0], 0.02, (40, 2)), rng.uniform(-1.5, 2.5, (12, 2))
    return np.round(np.concatenate((dense, wide, second, dust)), 3).tolist()


@pytest.mark.parametrize(("seed", "least", "samples", "limit"), [(1, 10, 5, 200_000), (2, 6, 3, 60), (3, 15, 5, 25)])
def test_equals_all_thresholds(spark, seed, least, samples, limit):
    pts = blobs(seed)
    pts += [pts[0]] * 3 + [[1.9, 1.9]] * 17 + [[-1.4, -1.4]] * 2
    got = found(spark, pts, min_cluster_size=least, min_samples=samples, problem_edges=limit)
    assert {frozenset(v) for k, v in got.items() if k >= 0} == brute(pts, least, samples, 16)


def test_topics_of_unequal_density_are_told_apart(spark):
    got = found(spark, blobs(4), min_cluster_size=15, min_samples=5)
    shares = [max(len(set(range(lo, hi)) & v) for k, v in got.items() if k >= 0) / (hi - lo) for lo, hi in ((0, 60), (60, 110), (110, 150))]
    assert len(got) - (-1 in got) == 3 and min(shares) > 0.75


def test_small_and_empty_maps_are_noise(spark):
    assert found(spark, [[0.0, 0.0], [1.0, 1.0]]) == {-1: {0, 1}}
    assert H.hierarchical_clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(0, None, 1.0, "c"), (1, 1.0, None, "c")], SCHEMA)
    assert {r.raw_cluster for r in H.hierarchical_clusters(rows).collect()} == {-1}


def test_events_meet_the_cluster_of_their_weight_without_all_pairs(spark):
    rng = np.random.default_rng(3)
    names = [(n, w, 100 * n + w) for n in (1, 2, 3) for w in sorted(rng.choice(400, 150, replace=False).tolist())]
    events = [(i, int(rng.integers(1, 5)), float(rng.integers(0, 400)), i % 4 + 1) for i in range(900)]
    tree = spark.createDataFrame([(n, float(w), c) for n, w, c in names], "name long, since double, cluster long")
    found = H._as_of(spark.createDataFrame(events, "spot long, parent long, w double, size long").repartition(7), tree)
    expected = {}
    for spot, parent, w, size in events:
        below = [(s, c) for n, s, c in names if n == parent and s <= w]
        if below:
            expected[spot] = (w, size, max(below)[1])
    assert {r.spot: (r.w, r.size, r.cluster) for r in found.collect()} == expected

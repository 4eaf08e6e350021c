from __future__ import annotations

import itertools

import numpy as np
import pytest

from clauseweave import settings as S
from clauseweave.operators import clusters as C
from clauseweave.operators import density as D
from clauseweave.operators import neighbours as N
from clauseweave.session import cut_lineage


def plain_clusters(v, min_size):
    """The same rule point by point: all distances, all merges, the whole condensed hierarchy."""
    n = len(v)
    d = N.distances(v, v)
    np.fill_diagonal(d, 0.0)
    core = np.sort(d, axis=1)[:, min(min_size, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    edges = sorted((reach[a, b], a, b) for a, b in itertools.combinations(range(n), 2))
    parts = {i: {i} for i in range(n)}
    of, tree = list(range(n)), {}
    for w, a, b in edges:
        x, y = of[a], of[b]
        if x != y:
            name = n + len(tree)
            tree[name] = (w, x, y)
            parts[name] = parts[x] | parts[y]
            for i in parts[name]:
                of[i] = name
    density = lambda w: 1 / max(w, D.SHORTEST)
    label = dict.fromkeys(range(n), -1)

    def condense(node, birth):
        """(stability of the best choice below, its clusters as sets) of a condensed cluster."""
        own, members = 0.0, set(parts[node])
        while True:
            if len(parts[node]) < min_size or node not in tree:
                return own, [members], own  # no more splits
            w, x, y = tree[node]
            big = [c for c in (x, y) if len(parts[c]) >= min_size]
            if len(big) == 2:
                own += len(parts[node]) * (density(w) - birth)
                found = [condense(c, density(w)) for c in big]
                under = sum(f[0] for f in found)
                if under > own:
                    return under, [m for f in found for m in f[1]], own
                return own, [members], own
            gone = parts[node] if not big else set().union(*(parts[c] for c in (x, y) if c not in big))
            own += len(gone) * (density(w) - birth)
            if not big:
                return own, [members], own
            node = big[0]

    root = n + len(tree) - 1
    # The root itself is never a cluster: go down to its first split.
    node = root
    while node in tree:
        w, x, y = tree[node]
        big = [c for c in (x, y) if len(parts[c]) >= min_size]
        if len(big) == 2:
            for c in big:
                for members in condense(c, density(w))[1]:
                    for i in members:
                        label[i] = min(members)
            break
        if not big:
            break
        node = big[0]
    return [label[i] for i in range(n)]


def groups(labels):
    found = {}
    for i, c in enumerate(labels):
        found.setdefault(c, set()).add(i)
    return {frozenset(m) for c, m in found.items() if c != -1}, frozenset(found.get(-1, ()))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored(spark, v, weights=None):
    rows = [(i, [float(x) for x in r], int(weights[i]) if weights is not None else 1) for i, r in enumerate(v)]
    return cut_lineage(spark.createDataFrame(rows, "id long, v array<double>, weight long"))


def planted(seed, sizes, noise, dim=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = unit(rng.normal(size=(len(sizes), dim)))
    body = [centres[g] + rng.normal(size=(n, dim)) * spread * rng.uniform(0.5, 2) for g, n in enumerate(sizes)]
    return unit(np.vstack([*body, rng.normal(size=(noise, dim))]))


@pytest.mark.parametrize(
    ("seed", "sizes", "noise", "spread"),
    [(1, [30, 25, 18, 12], 9, 0.05), (2, [40, 40, 40], 30, 0.25), (3, [15, 60, 9, 14, 22], 20, 0.12), (5, [], 120, 0.1)],
)
def test_same_clusters_as_point_by_point(spark, seed, sizes, noise, spread):
    v = planted(seed, sizes, noise, spread=spread)
    got = {r.id: r.cluster_id for r in D.density_clusters(stored(spark, v), min_size=10, k=len(v) - 1).collect()}
    assert groups([got[i] for i in range(len(v))]) == groups(plain_clusters(v, 10))


def test_copies_count_as_points(spark):
    """A vector that a third of all rows hold, one of few copies, and one row of its own each."""
    v = planted(6, [12, 14, 10], 6)
    weights = np.ones(len(v), int)
    weights[0], weights[20], weights[37] = 30, 4, 12
    repeated = np.repeat(v, weights, axis=0)
    want = plain_clusters(repeated, 10)
    first = np.cumsum(weights) - weights
    got = {r.id: r.cluster_id for r in D.density_clusters(stored(spark, v, weights), min_size=10, k=len(v) - 1).collect()}
    assert groups([got[i] for i in range(len(v))]) == groups([want[f] for f in first])


def test_sixty_groups_and_noise(spark):
    rng = np.random.default_rng(0)
    centres = unit(rng.normal(size=(60, 24)))
    # All groups lie around one direction, noise lies on the other side.
    middle = np.eye(24)[0] * 2
    rows = [(g, middle + centres[g] + rng.normal(size=24) * 0.02) for g in range(60) for _ in range(int(rng.integers(14, 60)))]
    rows += [(-1, -middle + 2 * unit(rng.normal(size=(1, 24)))[0]) for _ in range(8)]
    df = spark.createDataFrame([(i, g, [float(x) for x in v]) for i, (g, v) in enumerate(rows)], "id long, g int, v array<double>").repartition(6)
    out = C.discover_clusters(df, "v").collect()
    assert len(out) == len(rows)
    of_group = {g: {r.cluster_id for r in out if r.g == g} for g in range(-1, 60)}
    assert all(len(of_group[g]) == 1 and -1 not in of_group[g] for g in range(60))
    assert len(set().union(*(of_group[g] for g in range(60)))) == 60
    assert of_group[-1] == {-1}


def test_odd_vectors(spark, tmp_path):
    schema = "id long, v array<float>, cluster_id string, weight int, _label int"
    rows = [(1, None, "x", 1, 2), (2, [0.0, 0.0], "y", 1, 2), (3, [1.0, 0.0], "z", 1, 2), (4, [2.0, 0.0], "z", 1, 2), (None, [0.0, 5.0], None, None, None)]
    out = C.discover_clusters(spark.createDataFrame(rows, schema).drop("_label"), "v").collect()
    assert sorted((r.id or 0, r.cluster_id) for r in out) == [(0, -1), (1, -1), (2, -1), (3, -1), (4, -1)]
    copies = [(i, [1.0, 0.0] if i % 2 else [0.0, 2.0], "", 0, 0) for i in range(40)]
    out = C.discover_clusters(spark.createDataFrame(copies, schema).drop("_label"), "v").collect()
    assert len({r.cluster_id for r in out}) == 2 and -1 not in {r.cluster_id for r in out}
    assert C.discover_clusters(spark.createDataFrame([], schema).drop("_label"), "v").count() == 0


@pytest.mark.parametrize("rows", [3, 700, 3000])
def test_neighbours_like_brute_force(spark, rows):
    v = planted(8, [rows // 3] * 3, 0, dim=32, spread=0.3)
    points = cut_lineage(stored(spark, v).drop("weight"))
    found = {r.id: r.near for r in N.neighbour_graph(points, k=15).collect()}
    assert len(found) == len(v)
    d = N.distances(v, v)
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i, near in found.items():
        want = np.lexsort((np.arange(len(v)), d[i]))[: min(15, len(v) - 1)]
        assert [n.distance for n in near] == sorted(n.distance for n in near)
        assert all(n.distance == pytest.approx(d[i, n.id], abs=2e-7) for n in near)
        hits += len({n.id for n in near} & set(want.tolist()))
    assert hits >= 0.95 * len(v) * min(15, len(v) - 1)


@pytest.mark.parametrize("block", [128, 1 << 14])
def test_exact_neighbours(spark, monkeypatch, block):
    """Random directions, where the descent misses some, copies and equal distances."""
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    v = unit(np.random.default_rng(5).normal(size=(2100, 24)))
    v[40:100] = v[40]
    points = cut_lineage(stored(spark, v).drop("weight"))
    d = N.distances(v, v)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(v)), d.shape), d))[:, :15]
    found = {r.id: [n.id for n in r.near] for r in N.neighbour_graph(points, k=15).collect()}
    assert [found[i] for i in range(len(v))] == order.tolist()


def test_six_times_the_rows_travel_no_more_often():
    """Vectors go to each block once: the blocks follow the cores until one would be too large."""
    assert [N.block_count(n, 12) for n in (0, 512, 600, 10_256, 102_560, 615_360)] == [1, 1, 2, 12, 12, 12]
    assert N.block_count(N.EXACT_ROWS, 4) == 16


def test_neighbours_beyond_the_exact_rows(spark):
    v = planted(8, [1000] * 3, 0, dim=32, spread=0.3)
    found = {r.id: r.near for r in N.neighbour_graph(cut_lineage(stored(spark, v).drop("weight")), k=15, exact_rows=0).collect()}
    d = N.distances(v, v)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :15]
    assert sum(len({n.id for n in found[i]} & set(near[i].tolist())) for i in range(len(v))) >= 0.95 * near.size


def test_leaves_are_bounded_whatever_the_shape(spark):
    rng = np.random.default_rng(1)
    v = unit(np.vstack([rng.normal(size=(200, 8)), [1.0, *[0.0] * 7] + rng.normal(size=(2800, 8)) * 1e-3]))
    placed = N.leaves(cut_lineage(stored(spark, v).drop("weight")), trees=3, seed=2, leaf_rows=200)
    sizes = [r["count"] for r in placed.groupBy("tree", "leaf").count().collect()]
    assert sum(sizes) == 3 * len(v)
    assert max(sizes) <= 300


def test_spanning_forest_like_sorted_edges(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(rng.choice(80, 2, replace=False).tolist())) for _ in range(200)} | {(100 + i, 101 + i) for i in range(30)}
    edges = [(x, y, (float(rng.integers(1, 12)), x, y)) for x, y in pairs]  # many equal lengths
    above = {i: i for e in edges for i in e[:2]}

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    want = set()
    for x, y, e in sorted(edges, key=lambda e: e[2]):
        if find(x) != find(y):
            above[find(x)] = find(y)
            want.add((x, y, e))
    got = D.spanning_forest(spark.createDataFrame(edges, f"x long, y long, edge {D.EDGE}")).collect()
    assert len(got) == len(want)
    assert {(r.x, r.y, tuple(r.edge)) for r in got} == want
    assert D.spanning_forest(spark.createDataFrame([], f"x long, y long, edge {D.EDGE}")).count() == 0


def test_long_chains_of_small_components(spark):
    """Lengths that grow along a path: each point waits for the one before, and all join in few rounds."""
    n = 400
    points = stored(spark, np.ones((n, 1)))
    edges = spark.createDataFrame([((1.0 + i, i, i + 1),) for i in range(n - 1)], f"edge {D.EDGE}")
    found, links = D.regions(points, edges, 10)
    rows = {r.id: r for r in found.collect()}
    assert len(rows) == n and len({r.region for r in rows.values()}) == 1 and links.count() == 0
    assert all(rows[i].fallout.w == max(9.0, float(i)) for i in range(n))


def test_settings_have_no_cluster_count():
    assert not hasattr(S, "CLUSTER_COUNT")

"""Density clustering by blocks against the clustering of a whole matrix."""

import os

import numpy as np
import pytest

from weftline.operators import clustering as C
from weftline.operators import density as D


def points(n, centres, seed, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + rng.choice([0.1, 0.25, 1.0], n)[:, None] * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def same(a, b):
    """Equal partitions, noise included."""
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b)) and all((x < 0) == (y < 0) for x, y in pairs)


def test_trees():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 200):
        d = np.round(rng.random((n, n)), 1)  # many ties
        d = np.maximum(d, d.T)
        a, b, w = C.local_tree(d, rng.permutation(n))
        assert len(a) == n - 1
        u, v = np.triu_indices(n, 1)
        at = D.spanning(u, v, d[u, v], n)
        x, y, z = C.local_tree(d, np.arange(n))
        assert sorted(zip(u[at].tolist(), v[at].tolist())) == sorted(zip(x.tolist(), y.tolist())) and abs(w.sum() - z.sum()) < 1e-9


def test_equal_to_the_whole_matrix(spark):
    """Runs of 2,000 and of other sizes at once, in blocks much smaller than they are."""
    runs = {1: points(2000, 12, 4), 2: points(300, 5, 5), 3: points(1, 1, 6), 4: points(7, 2, 7), 5: np.repeat(points(3, 3, 8), 20, 0)}
    data = [(r, k, x.tolist()) for r, every in runs.items() for k, x in enumerate(every)]
    df = spark.createDataFrame([*data, (2, 1000, None), (2, 1001, [0.0] * 8)], "run_id int, id long, v array<double>").repartition(6)
    got = D.density_labels(df, "run_id", block=300).toPandas().sort_values(["run_id", "id"])
    assert len(got) == len(data) + 2
    for r, x in runs.items():
        mine = got[(got.run_id == r) & (got.id < 1000 if r == 2 else True)].label.to_numpy()
        whole = C.hdbscan(x, C.density_size(len(x)))
        if r == 5:
            assert len(set(mine.tolist())) == 3 and all(len(set(mine[k * 20 : k * 20 + 20].tolist())) == 1 for k in range(3))
        else:
            assert same(mine.tolist(), whole.tolist()), r
    assert set(got[got.id >= 1000][got.run_id == 2].label) == {-1}
    assert D.density_labels(df.limit(0), "run_id").count() == 0


@pytest.mark.skipif(not os.environ.get("LARGE"), reason="some minutes; set LARGE")
def test_fifty_thousand(spark):
    x = points(50_000, 30, 9)
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x.tolist())], "run_id int, id long, v array<double>").repartition(16)
    labels = D.density_labels(df, "run_id").toPandas()
    assert len(labels) == 50_000 and labels.label.max() >= 5


def test_few_edges_leave_a_pair_of_blocks():
    """Each pair of blocks sent a tree of all its points, so a run's last task had rows * rows / BLOCK edges; tiles of a block give the same tree."""
    x = points(900, 9, 3)
    x[700:720] = x[:20]
    d = np.maximum(0, np.round(1 - x @ x.T, 12))
    core = np.partition(d, 2, 1)[:, 2]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    at, far = D._nearest(x, x, 8, True)
    assert np.array_equal(np.sort(far, 1), np.sort(np.where(np.eye(len(x)), np.inf, d), 1)[:, :8])
    i = np.repeat(np.arange(len(x)), 8)
    a, b = np.minimum(i, at.ravel()), np.maximum(i, at.ravel())
    keep = D.spanning(a, b, reach[a, b], len(x))
    a, b = a[keep], b[keep]
    order, gap, edge, tree = D.merged(a, b, reach[a, b], len(x))
    top = np.zeros(len(x))
    np.maximum.at(top, tree, np.where(np.isinf(gap), 0, gap))
    for block in (900, 250):
        blocks = np.maximum.reduceat(gap, np.arange(0, len(x), block))
        sides = []
        for k in range(0, len(x), block):
            s = D._Side.__new__(D._Side)
            of = order[k : k + block]
            s.v, s.core, s.gap, s.top, s.part, s.rank, s.blocks = x[of], core[of], gap[k : k + block], top[tree][k : k + block], tree[k : k + block], of, blocks
            sides.append(s)
        more = [D.pair_edges(sides[p], sides[q], p, q, 64) for p in range(len(sides)) for q in range(p, len(sides))]
        u, v, w = (np.concatenate(z) for z in zip((a, b, reach[a, b]), *more))
        assert len(u) < 6 * len(x)
        got = D.spanning(u, v, w, len(x))
        want = D.spanning(*(np.triu_indices(len(x), 1)), reach[np.triu_indices(len(x), 1)], len(x))
        assert len(got) == len(x) - 1 and np.allclose(np.sort(w[got]), np.sort(reach[np.triu_indices(len(x), 1)][want]), atol=1e-12)

import math

import numpy as np
import pytest

from sonoquarry.llm import neighbours

from ..conftest import rows

DIMS = 16


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = np.round(x @ x.T, 6)
    out = []
    for a, i in enumerate(ids):
        near = sorted(((-g[a, b], ids[b]) for b in range(len(ids)) if b != a and g[a, b] >= least))[:k]
        out += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
    return sorted(out, key=repr)


def clusters(n, spread, seed=0, per=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, DIMS))
    x = np.repeat(centres, per, axis=0) + rng.normal(0, spread, (n * per, DIMS))
    return x * rng.uniform(0.1, 9, (len(x), 1))


def frame(spark, data):
    return spark.createDataFrame([(i, v, p, 0, "x") for i, v, p in data], "theme_id long, e array<float>, pos long, cell int, vec string")


def found(spark, data, **kw):
    return rows(neighbours.nearest(frame(spark, data), "theme_id", "e", "pos", dims=DIMS, **kw), "id", "other", "rank_no")


def test_chi_square():
    assert neighbours.chi2_survival(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert neighbours.chi2_survival(15.507313, 8) == pytest.approx(0.05, abs=1e-6)
    assert neighbours.chi2_survival(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert neighbours.chi2_bound(0.01, 16) == pytest.approx(31.999927, abs=1e-4) and neighbours.chi2_bound(2, 3) == 0
    assert math.isclose(neighbours.chi2_survival(0, 4), 1)


@pytest.mark.parametrize("levels", [10, 2])
def test_recall_with_a_deep_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(neighbours, "STEP_LEVELS", levels)  # fitted in one step and in several
    x = clusters(250, 0.12)
    vectors = {i: x[i].astype(np.float32) for i in range(len(x))}
    got = {r[:2] for r in found(spark, [(i, v.tolist(), i) for i, v in vectors.items()], cell=64, leaf=8, asking=100)}
    truth = {r[:2] for r in brute(vectors, 5, 0.9)}
    assert len(truth) > 1000 and got <= truth | {(b, a) for a, b in truth} and len(got & truth) >= 0.98 * len(truth)


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_leaves_are_visited_in_order_and_the_bound_stops_the_search():
    rng = np.random.default_rng(8)
    tree = neighbours.Tree(DIMS, 0.2)
    ids = np.arange(4096)
    dense = unit(rng.normal(size=(1, DIMS)) + rng.normal(0, 1e-2, (4096, 2)) @ rng.normal(size=(2, DIMS)))
    spread = unit(rng.normal(size=(4096, DIMS)))
    work = []
    for x in (dense, spread):
        counts = neighbours.Counts()
        q, p, c = neighbours.search(tree, x, ids, x[:256], ids[:256], np.full(256, 0.2), 5, 0.9, 64, counts)
        true = np.round(x[:256] @ x.T, 6)
        true[np.arange(256), np.arange(256)] = -1
        right = sum(c[q == i].min() == np.sort(true[i])[-5] for i in range(256) if (true[i] >= 0.9).sum() >= 5)
        assert right >= 0.95 * ((true >= 0.9).sum(1) >= 5).sum()
        work.append(counts.compared / (256 * 4096))
    assert work[0] < 0.4  # all 4096 are neighbours of all; the tightened bound leaves most of them out


def test_members_of_a_dense_group_stay_near_home():
    rng = np.random.default_rng(9)
    tree = neighbours.Tree(DIMS, 0.2)
    x = unit(rng.normal(size=(1, DIMS)) + rng.normal(0, 0.01, (8192, DIMS)))
    p = x @ tree.directions
    tree.cuts = neighbours.fit_levels(p, 0, 8)
    tree.calibrate(p)
    loose, tight = (len(tree.visits(p[:500], np.full(500, b))[0]) / 500 for b in (0.2, 5e-6))
    assert loose > 200 and tight < 60 and np.bincount(tree.home(p)).max() == 32


def test_simulated_neighbours_are_found_in_the_cells_that_are_visited():
    rng = np.random.default_rng(10)
    tree = neighbours.Tree(DIMS, 0.2)
    p = rng.normal(size=(4000, neighbours.DIRECTIONS))
    for depth in (3, 9, 20):  # the last looks at some directions twice
        tree.cuts = neighbours.fit_levels(rng.normal(size=(1 << min(depth + 2, 20), neighbours.DIRECTIONS)), 0, depth)
        tree.calibrate(p)
        q, near = rng.normal(size=(2, 300, neighbours.DIRECTIONS))
        target = tree.home(q + near * 0.2 ** 0.5)
        row, cell = tree.visits(q, np.full(300, 0.2))
        reached = set(zip(row.tolist(), cell.tolist())) | set(enumerate(tree.home(q).tolist()))
        assert len(reached) == len(row) + 300 and sum((i, c) in reached for i, c in enumerate(target.tolist())) >= 290


def test_hot_copies_and_ties(spark):
    x = clusters(6, 0.1, seed=2)
    data = [(i, x[i].astype(np.float32), i) for i in range(len(x))] + [(100 + i, (x[0] * 2).astype(np.float32), 100 + i) for i in range(60)]
    got = found(spark, [(i, v.tolist(), p) for i, v, p in data])
    expected = brute({i: v for i, v, _ in data}, 5, 0.9)
    assert got == expected
    assert [r[1] for r in got if r[0] == 159] == [0, 100, 101, 102, 103]


def test_dirty_rows(spark):
    good = [1.0] + [0.0] * (DIMS - 1)
    bad = [None, [], good[:-1], [None] + good[1:], [float("nan")] + good[1:], [float("inf")] + good[1:], [0.0] * DIMS]
    data = [(i, v, i) for i, v in enumerate(bad)] + [(50, good, 1), (51, good, 2), (51, [-x for x in good], 9), (None, good, 3), (52, [1e-30 * x for x in good], 4)]
    assert found(spark, data) == [(50, 51, 1), (50, 52, 2), (51, 50, 1), (51, 52, 2), (52, 50, 1), (52, 51, 2)]


def test_empty_single_and_pairs(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0] * DIMS, 0)]) == []
    df = neighbours.nearest(frame(spark, [(7, [1.0] * DIMS, 0), (3, [1.0] * DIMS, 1)]), "theme_id", "e", "pos", dims=DIMS)
    assert rows(neighbours.neighbour_pairs(df)) == [(3, 7)]

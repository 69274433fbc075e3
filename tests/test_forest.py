"""The forest's passes against subtrees grown in memory and against plain loops."""

import numpy as np
import pytest
from test_boosting import frame, rows_of

from wirelens.operators import forest
from wirelens.operators.models import AttackClassifier


def weights_of(label):
    return {k: len(label) / (3 * (label == k).sum()) for k in "abc"}


def test_passes_and_batches_grow_the_same_trees(spark):
    """Neither the rows a task may hold nor the batches change a tree, so no task needs more than its share."""
    x, label = rows_of(1200)
    df = frame(spark, x, label).repartition(3).cache()
    df.count()
    fits = [forest.fit(df, "label", "vector", weights_of(label), 8, 6, 42, **limits) for limits in (
        {}, {"local_rows": 150, "batch_bytes": 1200 * 10 * 3}, {"local_rows": 1})]
    assert len(fits[0].trees) == 8
    fresh, _ = rows_of(300, seed=1)
    for other in fits[1:]:
        assert [len(t.left) for t in other.trees] == [len(t.left) for t in fits[0].trees]
        np.testing.assert_array_equal(other.shares(fresh), fits[0].shares(fresh))


def test_subtree_equals_plain_loop():
    rng = np.random.default_rng(5)
    held = np.zeros((300, 6), np.uint8)
    held[:, :5] = rng.integers(0, 9, (300, 5))
    truth = ((held[:, 0] > 4) + (held[:, 1] > held[:, 2]) + (rng.random(300) < 0.2)).astype(np.int32) % 3
    times = forest.bootstrap(forest.tree_draws(np.arange(300).astype("uint64"), 7), 4)
    weights = np.array([1.0, 2.5, 0.5])
    # of seven features the last two take one bin
    plan = forest.Plan(7, np.array([0, 1, 2, 3, 4, 5, 5]), weights, 5, 7)
    own = np.flatnonzero(times)
    tree = forest.grow(plan, held[own], truth[own], times[own], 4, 1, 5)
    got = tree.shares[~tree.left[forest.descend(forest.packed(tree.feature, tree.cut, tree.left), held)]]

    def mass(rows):
        return np.bincount(truth[rows], times[rows], 3) * weights

    def impurity(rows):
        m = mass(rows)
        return m.sum() * (1 - ((m / m.sum()) ** 2).sum())

    def plain(rows, path, left):
        """(rows, shares) of the leaves."""
        best = (1e-12, None)
        whole = mass(rows)
        if left:
            for j in plan.tried(np.array([path]), 4)[0]:
                for cut in range(forest.BINS - 1):
                    parts = [rows[held[rows, j] <= cut], rows[held[rows, j] > cut]]
                    if all(times[p].sum() for p in parts):
                        gain = (impurity(rows) - sum(map(impurity, parts))) / whole.sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, parts)
        if best[1] is not None:
            low, high = (plain(p, 2 * path + i, left - 1) for i, p in enumerate(best[1]))
            if len(low) > 1 or len(high) > 1 or low[0][1].argmax() != high[0][1].argmax():
                return low + high
        return [(rows, whole / whole.sum())]

    leaves = plain(own, 1, 5)
    assert len(leaves) == len(tree.shares) > 5
    for rows, shares in leaves:
        np.testing.assert_allclose(got[rows], np.tile(shares, (len(rows), 1)), atol=1e-6)


def test_bootstrap_counts_are_poisson():
    times = forest.bootstrap(forest.tree_draws(np.arange(200_000).astype("uint64"), 42), 3)
    share = np.bincount(times, minlength=4)[:4] / len(times)
    np.testing.assert_allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)


def test_rows_of_deep_trees_are_not_read_once_per_group_of_nodes(spark):
    """Small tables take one pass for all subtrees, however many nodes the trees have."""
    x, label = rows_of(3000)
    label = np.random.default_rng(2).permutation(label)  # nothing to learn: trees grow to their depth
    df = frame(spark, x, label)
    tracker, group = spark.sparkContext.statusTracker(), "forest-passes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        model = AttackClassifier(trees=20, depth=12).fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(t.left) for t in model.trees.trees) > 10_000
    assert len(tracker.getJobIdsForGroup(group)) < 30


@pytest.mark.parametrize("label", ["'a'", "IF(id = 1, 'a', NULL)"])
def test_one_class(spark, label):
    df = spark.range(20).selectExpr("id", "array(double(id), 1d) AS vector", f"{label} AS label")
    model = AttackClassifier(trees=5, depth=3).fit(df)
    assert model.classes == ["a"]
    assert {r.confidence for r in model.transform(df.where("label = 'a'")).collect()} == {1.0}


def test_half_a_million_rows_are_grown_without_a_pass_a_level(spark, monkeypatch):
    """A pass over all rows for each level and all trees took as long as the growing itself."""
    def passes(*_):
        raise AssertionError("a pass over the blocks for nodes that one task can hold")

    monkeypatch.setattr(forest, "_splits", passes)
    df = spark.range(500_000).selectExpr("IF(hash(id) % 3 = 0, 'a', 'b') AS label",
                                         "array(double(id % 40), double(hash(id) % 9)) AS vector")
    model = forest.fit(df.cache(), "label", "vector", {"a": 1.0, "b": 1.0}, 2, 4, 42)
    assert len(model.trees) == 2


def test_counts_of_large_and_small_nodes():
    rng = np.random.default_rng(3)
    rows, classes, sizes = 20_000, 11, [3, forest.OWN_ROWS, 0, 9000, 1, forest.OWN_ROWS - 1, 40, 2]
    held, truth = rng.integers(0, forest.BINS, (rows, 7)).astype(np.uint8), rng.integers(0, classes, rows)
    held[:, 6] = 0  # stands for all features of one bin
    first, own = np.concatenate([[0], np.cumsum(sizes)]), rng.permutation(rows)[:sum(sizes)]
    times = rng.integers(1, 4, len(own)).astype(float)
    tried = np.sort(rng.integers(0, 7, (len(sizes), 4)), axis=1)
    got = forest.Cells(held, truth, classes).counted(own, first, times, tried)
    want = np.zeros((classes, len(sizes), 4, forest.BINS))
    node = np.repeat(np.arange(len(sizes)), sizes)
    for j in range(4):
        np.add.at(want, (truth[own], node, j, held[own, tried[node, j]]), times)
    np.testing.assert_array_equal(got, want)


def test_rows_in_the_order_of_their_nodes():
    for number in (3, 40_000):
        place = np.random.default_rng(4).integers(-1, number, 5000)
        order, first = forest.by_place(place, number)
        assert order.tolist() == [i for n in range(number) for i in np.flatnonzero(place == n)] if number < 9 \
            else (np.diff(place[order]) >= 0).all()
        np.testing.assert_array_equal(place[order], np.repeat(np.arange(number), np.diff(first)))


def test_nodes_are_halved_without_sorting():
    """Rows of each node go to its two halves in their order; a half may be empty."""
    rng = np.random.default_rng(4)
    first = np.array([0, 5, 6, 40, 90])
    high = rng.random(90) < 0.4
    high[:5], high[6:40] = True, False
    order, ends = forest.halves(high, first)
    node = np.repeat(np.arange(4), np.diff(first))
    assert order.tolist() == np.argsort(2 * node + high, kind="stable").tolist()
    assert np.diff(ends).tolist() == np.bincount(2 * node + high, minlength=8).tolist()


def test_bootstraps_near_a_threshold(monkeypatch):
    draws = np.concatenate([forest._POISSON, forest._POISSON - 1, forest._POISSON + 1])
    monkeypatch.setattr(forest, "tree_draws", lambda keys, tree: keys)
    np.testing.assert_array_equal(forest.bootstrap(draws, 0),
                                  np.searchsorted(forest._POISSON, draws, side="right"))

"""Boosted trees against a plain loop, and histogram passes against subtrees grown in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.operators import boosting
from wirelens.operators.models import AttackClassifier, AttackClassifierModel


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    label = np.where(x[:, 0] + x[:, 1] ** 2 > 1, "a", np.where(x[:, 2] > 0.3, "b", "c"))
    return x, label


def frame(spark, x, label):
    return spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label.tolist()))],
                                 "id long, vector array<double>, label string")


def plain_tree(bins, g, h, depth, step, ridge=1.0, least=1.0):
    """Value per row of the tree that tries every cut of every feature in turn."""
    def value(rows, left):
        best = (boosting.MIN_GAIN, None)
        if left:
            for j in range(bins.shape[1]):
                for cut in range(boosting.BINS - 1):
                    low = rows[bins[rows, j] <= cut]
                    high = rows[bins[rows, j] > cut]
                    if h[low].sum() < least or h[high].sum() < least:
                        continue
                    gain = round(sum(s * g[r].sum() ** 2 / (h[r].sum() + ridge)
                                     for s, r in ((0.5, low), (0.5, high), (-0.5, rows))), 9)
                    if gain > best[0]:
                        best = (gain, (low, high))
        if best[1] is None:
            out[rows] = -step * g[rows].sum() / (h[rows].sum() + ridge)
        else:
            for part in best[1]:
                value(part, left - 1)

    out = np.zeros(len(bins))
    value(np.arange(len(bins)), depth)
    return out


@pytest.mark.parametrize("local_rows", [1 << 16, 60, 1])
def test_rounds_equal_plain_loop(spark, local_rows):
    x, label = rows_of(240)
    model = boosting.fit(frame(spark, x, label).repartition(3), "label", "vector", rounds=3, depth=3,
                         step=0.3, local_rows=local_rows)
    assert model.classes == ["a", "b", "c"] and len(model.rounds) == 3
    bins = boosting.binned(x, model.edges)
    margins, truth = np.zeros((240, 3)), np.array([model.classes.index(k) for k in label])
    for _ in range(3):
        p = boosting.softmax(margins)
        for k in range(3):
            g, h = p[:, k] - (truth == k), 2 * p[:, k] * (1 - p[:, k])
            margins[:, k] += plain_tree(bins, g, h, 3, 0.3)
    np.testing.assert_allclose(model.margins(x), margins, atol=1e-9)


def test_margins_are_stored_between_rounds(spark, monkeypatch):
    x, label = rows_of(150)
    df = frame(spark, x, label)
    often = boosting.fit(df, "label", "vector", rounds=5, depth=2)
    monkeypatch.setattr(boosting, "FOLD", 2)
    np.testing.assert_allclose(
        boosting.fit(df, "label", "vector", rounds=5, depth=2).margins(x), often.margins(x))


def test_classifier_learns_and_survives_saving(spark, tmp_path):
    x, label = rows_of(600)
    fresh, truth = rows_of(300, seed=1)
    model = AttackClassifier(boosted=True, rounds=30, boost_depth=4, step=0.3).fit(frame(spark, x, label))
    model.save(str(tmp_path / "model"))
    loaded = AttackClassifierModel.load(spark, str(tmp_path / "model"))
    test = frame(spark, fresh, truth)
    first = model.probabilities(test).orderBy("id").collect()
    assert [r.probabilities for r in first] == [
        r.probabilities for r in loaded.probabilities(test).orderBy("id").collect()]
    assert all(abs(sum(r.probabilities) - 1) < 1e-12 for r in first)
    guess = [model.classes[int(np.argmax(r.probabilities))] for r in first]
    assert np.mean(np.array(guess) == truth) > 0.93
    assert model.transform(test).where(F.col("attack_type") == F.col("label")).count() > 0.93 * 300


def test_odd_rows(spark):
    rows = [([1.0, 2.0], "a"), ([None, float("nan")], "b"), (None, "a"), ([1.0], "b"), ([5.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vector array<double>, label string")
    model = boosting.fit(df, "label", "vector", rounds=2)
    assert all(len(r.probabilities) == 2 for r in model.probabilities(df).collect())
    one = boosting.fit(df.where("label = 'a'"), "label", "vector")
    assert len(one.rounds) == 1  # nothing to split
    assert boosting.fit(df.where("false"), "label", "vector").rounds == []


def test_subtrees_of_a_round_are_dealt_to_a_task_each(spark, monkeypatch):
    """Hashes of few slot numbers meet in some tasks while others have nothing to grow."""
    x, label = rows_of(400)
    data = boosting.binned_blocks(frame(spark, x, label), "label", "vector", boosting.BINS,
                                  lambda ids, classes: np.zeros((len(ids), classes)))
    seen, width = [], len(data.active)

    def watched(self, *args, f=type(data.rows).groupBy):
        seen.append(self.rdd.glom().map(len).collect())
        return f(self, *args)

    monkeypatch.setattr(type(data.rows), "groupBy", watched)
    slots = [{0: k} for k in range(3)]
    found = boosting._subtrees(data.rows, [], [boosting.Tree() for _ in slots], slots, [3] * 3, width,
                               (0.1, 1.0, 1.0, boosting.BINS))
    assert sorted(found) == [0, 1, 2] and all(len(t.left) > 1 for t in found.values())
    assert [n > 0 for n in seen[0]] == [True] * 3


def test_equal_features_are_kept_once(spark, monkeypatch):
    """Features that follow from one another need no sums of their own; the trees stay the same."""
    x, label = rows_of(240)
    last = x[:, 1].copy()
    last[-1] = x[:, 1].max() + 1  # differs in one block only
    wide = np.column_stack([x[:, 0], 3 * x[:, 0] + 1, x[:, 1], last, x[:, 0], x[:, 2]])
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    data = boosting.binned_blocks(frame(spark, wide, label), "label", "vector", boosting.BINS,
                                  lambda ids, classes: np.zeros((len(ids), classes)))
    kept = boosting.without_twins(data)
    assert data.active == [0, 1, 2, 3, 4, 5] and kept.active == [0, 2, 3, 5]
    model = boosting.fit(frame(spark, wide, label), "label", "vector", rounds=2, depth=3)
    monkeypatch.setattr(boosting, "without_twins", lambda found: found)
    plain = boosting.fit(frame(spark, wide, label), "label", "vector", rounds=2, depth=3)
    for a, b in zip(sum(model.rounds, []), sum(plain.rounds, []), strict=True):
        assert (a.feature, a.cut, a.left) == (b.feature, b.cut, b.left)
        np.testing.assert_allclose(a.value, b.value, atol=1e-12)


def test_passes_have_few_columns(spark, monkeypatch):
    """A column per bin and value made Spark plan and compile each pass longer than it ran."""
    x, label = rows_of(200)
    seen = []

    def watched(self, f=type(spark.range(1)).toArrow):
        seen.append(len(self.columns))
        return f(self)

    monkeypatch.setattr(type(spark.range(1)), "toArrow", watched)
    boosting.fit(frame(spark, x, label), "label", "vector", rounds=1, depth=2, local_rows=1)
    assert len(seen) >= 2 and max(seen) <= 8


def test_of_two_sisters_the_smaller_is_summed(spark, monkeypatch):
    """Only nodes too large for a task take passes, and a pass leaves out what remains of their parents."""
    x, label = rows_of(300)
    seen, read = [], boosting._histograms

    def watched(rows, recent, growing, slots, *args):
        found = read(rows, recent, growing, slots, *args)
        seen.append([(k, n, found[slot][0, :, 2].sum()) for k, known in enumerate(slots) for n, slot in known.items()])
        return found

    monkeypatch.setattr(boosting, "_histograms", watched)
    boosting.fit(frame(spark, x, label), "label", "vector", rounds=1, depth=3, local_rows=1)
    assert [held for _, _, held in seen[0]] == [300] * 3
    below = {(k, n): held for k, n, held in seen[1]}
    assert len(below) == 3 and all(n in (1, 2) and held <= 150 for (_, n), held in below.items())
    assert all((k, boosting.sister(n)) not in {(k, n) for k, n, _ in found} for found in seen[1:] for k, n, _ in found)
    seen.clear()
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 200 * (3 * 4 + 40))  # 200 rows of four features
    boosting.fit(frame(spark, x, label), "label", "vector", rounds=1, depth=3)
    assert 1 <= len(seen) <= 3 and [held for _, _, held in seen[0]] == [300] * 3
    seen.clear()
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 300 * (3 * 4 + 40))
    boosting.fit(frame(spark, x, label), "label", "vector", rounds=1, depth=3)
    assert not seen

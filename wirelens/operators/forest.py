"""Random forest over quantile bins.

Every tree sees a bootstrap of all rows (Poisson counts from hashes of row number and tree) and tries
``ceil(sqrt(features))`` features a node. Nodes with more than ``LOCAL_ROWS`` rows are split by passes
over the blocks: tasks count their rows per (node, feature, bin, class), one group per node adds these up
and picks the split. The rows of smaller nodes are brought together, and one task grows the subtree from
the same counts. Counts are whole numbers and all draws are hashes, so the trees do not depend on which of
the two ways a node went. Subtrees are grown in batches of trees, so that the rows shuffled for a batch
stay within ``BATCH_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.operators.boosting import BINS, _matrix, binned, binned_blocks, descend, packed, read_blocks
from wirelens.operators.iforest import tree_draws

# rows of a node whose subtree one task grows, about 40 bytes each and four times that while it works
LOCAL_ROWS = 1 << 20
# shuffled bytes of a batch of trees
BATCH_BYTES = 3 << 30
# histogram cells that are compared at a time
CELLS = 1 << 18
# rows from which a node is counted by itself, and rows that are counted at a time, which fit a core's cache
OWN_ROWS, GROUP_ROWS = 1 << 10, 1 << 13
MIN_GAIN = 1e-12
# a row is in a bootstrap as often as thresholds are at most its draw
_POISSON = np.array([int(2.0 ** 64 * min(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)),
                                         1 - 2.0 ** -53)) for k in range(12)], "uint64")


# the same by a draw's upper half, where no threshold lies within it
_HALF = np.searchsorted(_POISSON, np.arange(1 << 16, dtype="uint64") << np.uint64(48), side="right").astype(np.uint8)
_HALF[(_POISSON >> np.uint64(48)).astype(int)] = 255


def bootstrap(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap."""
    draws = tree_draws(keys, tree)
    out = _HALF.take((draws >> np.uint64(48)).astype(np.int64))
    near = np.flatnonzero(out == 255)
    out[near] = np.searchsorted(_POISSON, draws[near], side="right")
    return out


def drawn_features(path: np.ndarray, tree: int, seed: int, width: int) -> np.ndarray:
    """(node, features tried there) for nodes named by their path: root 1, children 2i and 2i + 1."""
    number = math.ceil(math.sqrt(width))
    keys = tree_draws(tree_draws(path.astype("uint64"), seed), tree)
    draws = tree_draws(keys[:, None], np.arange(width)[None, :])
    return np.sort(np.argpartition(draws, number - 1, axis=1)[:, :number], axis=1)


class Cells:
    """Rows by class and bin: a number below classes * BINS per row and feature, of which ``held`` gives the
    bins. Places looked up with mode "clip" all exist; numpy finds them faster than with its check."""

    def __init__(self, held: np.ndarray, truth: np.ndarray, classes: int) -> None:
        kind = next(t for t in (np.uint8, np.uint16, np.int32) if classes * BINS <= np.iinfo(t).max + 1)
        self.classes, self.width = classes, held.shape[1]
        self.by_row = held.astype(kind)
        self.by_row += (truth * BINS).astype(kind)[:, None]
        # turned in pieces that fit a cache
        self.by_feature = np.empty((self.width, len(held)), kind)
        for lo in range(0, len(held), GROUP_ROWS):
            self.by_feature[:, lo:lo + GROUP_ROWS] = self.by_row[lo:lo + GROUP_ROWS].T

    def bins(self, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The bin of each row in its own feature."""
        return self.by_row.ravel().take(rows * self.width + feature, mode="clip") % BINS

    def counted(self, rows: np.ndarray, first: np.ndarray, times: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """(class, node, tried feature, bin) counts of ``rows``, which are in the order of their nodes: node
        i has those from ``first[i]`` on. ``times`` are the numbers of the rows."""
        number, picks, size = len(tried), tried.shape[1], self.classes * BINS
        out, held = np.empty((number, picks, size)), np.diff(first)
        for i in np.flatnonzero(held >= OWN_ROWS):
            # features that take one bin are one column
            known = {feature: np.zeros(size) for feature in tried[i].tolist()}
            for lo in range(first[i], first[i + 1], GROUP_ROWS):
                span = slice(lo, min(lo + GROUP_ROWS, first[i + 1]))
                own, often = rows[span], times[span]
                for feature, total in known.items():
                    total += np.bincount(self.by_feature[feature].take(own, mode="clip"), often, size)
            out[i] = [known[feature] for feature in tried[i].tolist()]
        # nodes side by side, as many as there is room for
        few, ends = held < OWN_ROWS, first[1:]
        flat, i = self.by_row.ravel(), 0
        while i < number:
            if not few[i]:
                i += 1
                continue
            stop = max(i + 1, int(np.searchsorted(ends, first[i] + GROUP_ROWS, side="right")))
            big = np.flatnonzero(~few[i:stop])
            stop = min(i + int(big[0]) if len(big) else stop, i + max(1, CELLS // size))
            span = slice(first[i], first[stop])
            own, often = held[i:stop], times[span]
            start, offset = rows[span] * self.width, np.repeat(np.arange(stop - i) * size, own)
            for j in range(picks):
                at = offset + flat.take(start + np.repeat(tried[i:stop, j], own), mode="clip")
                out[i:stop, j] = np.bincount(at, often, (stop - i) * size).reshape(-1, size)
            i = stop
        return np.ascontiguousarray(out.reshape(number, picks, self.classes, BINS).transpose(2, 0, 1, 3))


def by_place(place: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by their nodes 0 to ``number`` - 1, without those at -1; each node's first place in
    it, and the end)."""
    # short numbers are sorted by their digits
    kind = np.int16 if number < 1 << 15 else np.int32
    order = np.argsort(place.astype(kind), kind="stable")
    held = np.bincount(place + 1, minlength=number + 1)
    return order[held[0]:], np.concatenate([[0], np.cumsum(held[1:])])


def halves(high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by their nodes' halves, first those not ``high``; each half's first place in it, and
    the end) of rows in the order of their nodes, of which none is empty."""
    up, down = np.flatnonzero(high), np.flatnonzero(~high)
    ups = np.add.reduceat(high, first[:-1], dtype=np.int64)
    held = np.stack([np.diff(first) - ups, ups], axis=1)
    ends = np.concatenate([[0], np.cumsum(held.ravel())])
    order = np.empty(len(high), np.int64)
    for side, rows in ((0, down), (1, up)):
        # a node's rows of this side come one after the other, here and in ``rows``
        before = np.cumsum(held[:, side]) - held[:, side]
        order[np.arange(len(rows)) + np.repeat(ends[side:-1:2] - before, held[:, side])] = rows
    return order, ends


def best_cuts(hist: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain of Gini impurity, which tried feature, cut, class counts up to the cut) per node."""
    low = np.cumsum(hist, axis=-1)
    n_left, n_right, left, right = (np.zeros((*hist.shape[1:3], BINS - 1)) for _ in range(4))
    whole = low[:, :, 0, -1] * weights[:, None]
    for k, weight in enumerate(weights):
        x = low[k, :, :, :-1] * weight
        y = low[k, :, :, -1:] * weight - x
        n_left += x
        n_right += y
        x *= x
        y *= y
        left += x
        right += y
    with np.errstate(divide="ignore", invalid="ignore"):
        left /= n_left
        right /= n_right
    left += right
    # a side without rows weighs exactly nothing
    left[(n_left == 0) | (n_right == 0)] = -np.inf
    left = left.reshape(len(left), -1)
    at, nodes = left.argmax(axis=1), np.arange(len(left))
    feature, cut = at // (BINS - 1), at % (BINS - 1)
    n = whole.sum(axis=0)
    gain = left[nodes, at] / n - (whole ** 2).sum(axis=0) / n ** 2
    return gain, feature, cut, low[:, nodes, feature, cut].T


@dataclass
class Trees:
    """Nodes of one tree: rows with a bin of at most ``cut`` go to ``left``, others to the node after it.
    A leaf's ``left`` is ~i, where ``shares[i]`` are its class shares."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    shares: np.ndarray


def pruned(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, counts: np.ndarray, weights: np.ndarray
           ) -> Trees:
    """Sister leaves of one class are put together, as Spark's forests do. Leaves come with left -1, and
    children behind their parents."""
    weighted = counts * weights
    guess, left = weighted.argmax(axis=1), left.copy()
    while True:
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], left[inner] + 1
        same = inner[(left[a] < 0) & (left[b] < 0) & (guess[a] == guess[b])]
        if not len(same):
            break
        left[same] = -1
    # nodes below the new leaves go; parents are numbered before children
    alive, layer = np.zeros(len(left), bool), np.zeros(1, np.int64)
    while len(layer):
        alive[layer] = True
        down = left[layer][left[layer] >= 0]
        layer = np.concatenate([down, down + 1])
    number, leaf = np.cumsum(alive) - 1, alive & (left < 0)
    out = np.where(left >= 0, number[left], ~(np.cumsum(leaf) - 1)).astype(np.int32)
    shares = weighted[leaf] / weighted[leaf].sum(axis=1, keepdims=True)
    return Trees(feature[alive].astype(np.uint16), cut[alive].astype(np.uint8), out[alive],
                 shares.astype(np.float32))


@dataclass
class Plan:
    """What every task needs; ``stored`` gives the place of a feature in the blocks, the last of them
    holds zeros for features that take one bin."""

    width: int
    stored: np.ndarray
    weights: np.ndarray
    depth: int
    seed: int

    def tried(self, path: np.ndarray, tree: int) -> np.ndarray:
        return self.stored[drawn_features(path, tree, self.seed, self.width)]


def _nodes_of(rows: np.ndarray, first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their nodes, and where each begins, of some of the nodes."""
    if len(nodes) == len(first) - 1:
        return rows, first
    held = np.diff(first)
    kept = np.zeros(len(held), bool)
    kept[nodes] = True
    return rows[np.repeat(kept, held)], np.concatenate([[0], np.cumsum(held[nodes])])


def grow(plan: Plan, held: np.ndarray, truth: np.ndarray, times: np.ndarray, tree: int, root: int,
         levels: int) -> Trees:
    """The subtree of ``levels`` splits below the node ``root``, level by level."""
    classes = len(plan.weights)
    counts = np.bincount(truth, times, classes)[None, :]
    cells, times = Cells(held, truth, classes), times.astype(float)
    # rows in the order of their nodes, of which each has those from ``first`` on
    path, rows, first, parts, nodes = (np.array([root]), np.arange(len(truth)), np.array([0, len(truth)]), [], 0)
    for level in range(levels + 1):
        number = len(path)
        feature, cut, left = np.zeros(number, np.int64), np.zeros(number, np.int64), np.full(number, -1)
        parts.append((feature, cut, left, counts))
        open_ = np.flatnonzero((counts > 0).sum(axis=1) > 1) if level < levels else []
        if not len(open_):
            break
        rows, first = _nodes_of(rows, first, open_)
        tried, often = plan.tried(path[open_], tree), times.take(rows, mode="clip")
        step = max(1, CELLS // (tried.shape[1] * BINS * classes))
        found = []
        for start in range(0, len(open_), step):
            ends = first[start:start + step + 1]
            found.append(best_cuts(cells.counted(rows[ends[0]:ends[-1]], ends - ends[0], often[ends[0]:ends[-1]],
                                                 tried[start:start + step]), plan.weights))
        gain, which, at, low = (np.concatenate(x) for x in zip(*found, strict=True))
        split = np.flatnonzero(gain > MIN_GAIN)
        node = open_[split]
        feature[node], cut[node] = tried[split, which[split]], at[split]
        left[node] = nodes + number + 2 * np.arange(len(split))
        nodes += number
        if not len(split):
            break
        rows, first = _nodes_of(rows, first, split)
        held = np.diff(first)
        high = cells.bins(rows, np.repeat(feature[node], held)) > np.repeat(cut[node], held)
        order, first = halves(high, first)
        rows = rows.take(order, mode="clip")
        counts = np.stack([low[split], counts[node] - low[split]], axis=1).reshape(-1, classes)
        path = (2 * path[node][:, None] + np.arange(2)).ravel()
    return pruned(*(np.concatenate(x) for x in zip(*parts, strict=True)), plan.weights)


class Top:
    """The split part of a tree above the subtrees that tasks grow."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.path = [0], [0], [-1], [1]
        self.counts: list[np.ndarray | None] = [None]
        self.open: dict[int, float] = {}

    def split(self, node: int, feature: int, cut: int, low: np.ndarray, high: np.ndarray) -> list[int]:
        first = len(self.left)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        for side, held in enumerate((low, high)):
            for column, value in ((self.feature, 0), (self.cut, 0), (self.left, -1),
                                  (self.path, 2 * self.path[node] + side), (self.counts, held)):
                column.append(value)
        return [first, first + 1]

    def places(self, held: np.ndarray, known: dict[int, int]) -> np.ndarray:
        """The number of the node in which each row ends, -1 if it has none."""
        place = np.full(len(self.left), -1)
        place[list(known)] = list(known.values())
        columns = map(np.array, (self.feature, self.cut, self.left))
        return place[descend(packed(*columns), held)]

    def joined(self, below: dict[int, Trees], weights: np.ndarray) -> Trees:
        """The whole tree; splits over sister leaves of one class are taken back here, too."""
        below = dict(below)
        left = list(self.left)
        for node, held in enumerate(self.counts):
            if left[node] < 0 and node not in below:
                share = (held * weights / (held * weights).sum()).astype(np.float32)
                below[node] = Trees(*(np.zeros(1, t) for t in (np.uint16, np.uint8)),
                                    np.array([-1], np.int32), share[None, :])
        for node in range(len(left) - 1, -1, -1):  # children are behind their parents
            if left[node] >= 0:
                pair = [below.get(left[node] + side) for side in (0, 1)]
                if all(t is not None and len(t.left) == 1 for t in pair) and \
                        pair[0].shares[0].argmax() == pair[1].shares[0].argmax():
                    total = (sum(self.counts[left[node] + side] for side in (0, 1))) * weights
                    del below[left[node]], below[left[node] + 1]
                    below[node] = Trees(pair[0].feature, pair[0].cut, pair[0].left,
                                        (total / total.sum()).astype(np.float32)[None, :])
                    left[node] = -1
        order, number, pending = [], {}, [0]
        for node in pending:
            if left[node] >= 0:
                number[left[node]], number[left[node] + 1] = len(pending), len(pending) + 1
                pending += [left[node], left[node] + 1]
            order.append(node)
        top = len(order)
        feature, cut = (np.array([c[i] for i in order], t) for c, t in (
            (self.feature, np.uint16), (self.cut, np.uint8)))
        to = np.array([number[left[i]] if left[i] >= 0 else 0 for i in order], np.int32)
        columns, shares, nodes, leaves = [[feature], [cut], [to]], [], top, 0
        for i, node in enumerate(order):
            if left[node] >= 0:
                continue
            t = below[node]
            moved = np.where(t.left >= 0, t.left + (nodes - 1), t.left - leaves).astype(np.int32)
            feature[i], cut[i], to[i] = t.feature[0], t.cut[0], moved[0]
            for column, new in zip(columns, (t.feature, t.cut, moved), strict=True):
                column.append(new[1:])
            shares.append(t.shares)
            nodes, leaves = nodes + len(t.left) - 1, leaves + len(t.shares)
        return Trees(*map(np.concatenate, columns), np.concatenate(shares))


def _rows_of(batch: pa.RecordBatch, stored: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins with a row per table row and zeros behind, class codes, keys of the bootstraps)."""
    held, truth, numbers = read_blocks(batch, stored)
    wide = np.zeros((len(truth), stored + 1), np.uint8)
    wide[:, :-1] = held.T
    return wide, truth, tree_draws(np.frombuffer(numbers, np.int64).view("uint64"), seed)


def _in_nodes(top: Top, known: dict[int, int], held: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the bootstrap in the order of the numbered nodes that they reach, where each node's begin)."""
    own = np.flatnonzero(times)
    if len(top.left) == 1:
        return own, np.array([0, len(own)])
    place = top.places(held.take(own, axis=0), known)
    order, starts = by_place(np.where(place < 0, -1, place - min(known.values())), len(known))
    return own.take(order), starts


def _splits(rows: DataFrame, tops: dict[int, Top], slots: dict[int, dict[int, int]], plan: Plan, stored: int
            ) -> dict[int, dict]:
    """The best split of every numbered node, from counts of all tasks."""
    classes = len(plan.weights)
    tried = {tree: plan.tried(np.array([tops[tree].path[n] for n in known]), tree)
             for tree, known in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, truth, keys = _rows_of(batch, stored, plan.seed)
            cells = Cells(held, truth, classes)
            for tree, known in slots.items():
                first, times = min(known.values()), bootstrap(keys, tree)
                own, starts = _in_nodes(tops[tree], known, held, times)
                hist = cells.counted(own, starts, times.take(own).astype(float), tried[tree])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + len(known)), pa.int32()),
                     pa.array([hist[:, i].astype(np.int32).tobytes() for i in range(len(known))],
                              pa.binary())], ["slot", "hist"])

    def pick(table: pa.Table) -> pa.Table:
        total = 0
        for h in table.column(1):
            total = total + np.frombuffer(h.as_py(), np.int32).astype(np.int64)
        hist = total.reshape(classes, 1, -1, BINS)
        gain, which, cut, low = best_cuts(hist, plan.weights)
        whole = hist[:, 0, 0].sum(axis=-1)
        return pa.table([table.column(0)[:1], *[pa.array(x, t) for x, t in (
            (gain, pa.float64()), (which, pa.int32()), (cut, pa.int32()))],
            *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (low[0].astype(np.int64), whole)]],
            names=["slot", "gain", "which", "cut", "low", "whole"])

    found = rows.mapInArrow(run, "slot int, hist binary").groupBy("slot").applyInArrow(
        pick, "slot int, gain double, which int, cut int, low array<long>, whole array<long>")
    out = {r["slot"]: r for r in found.toArrow().to_pylist()}
    for tree, known in slots.items():
        for i, slot in enumerate(known.values()):
            if slot in out:
                out[slot]["feature"] = int(tried[tree][i, out[slot]["which"]])
    return out


def _subtrees(rows: DataFrame, tops: dict[int, Top], slots: dict[int, dict[int, int]], plan: Plan,
              stored: int) -> dict[int, Trees]:
    """The subtree below every numbered node."""
    about = {slot: (tree, tops[tree].path[node]) for tree, known in slots.items()
             for node, slot in known.items()}
    kind = np.uint8 if len(plan.weights) <= 256 else np.int32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, truth, keys = _rows_of(batch, stored, plan.seed)
            truth = truth.astype(kind)
            for tree, known in slots.items():
                first, times = min(known.values()), bootstrap(keys, tree)
                own, starts = _in_nodes(tops[tree], known, held, times)
                for i in np.flatnonzero(np.diff(starts)).tolist():
                    mine = own[starts[i]:starts[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first + i], pa.int32()),
                         *[pa.array([x.take(mine, axis=0).tobytes()], pa.binary()) for x in (held, truth, times)]],
                        ["slot", "bins", "truth", "times"])

    def finish(table: pa.Table) -> pa.Table:
        slot = table.column(0)[0].as_py()
        tree, path = about[slot]
        held, truth, times = (np.frombuffer(b"".join(table.column(i).to_pylist()), t) for i, t in (
            (1, np.uint8), (2, kind), (3, np.uint8)))
        t = grow(plan, held.reshape(-1, stored + 1), truth.astype(np.int32), times, tree, path,
                 plan.depth - (path.bit_length() - 1))
        return pa.table([pa.array([slot], pa.int32()),
                         *[pa.array([x.tobytes()], pa.binary()) for x in (t.feature, t.cut, t.left, t.shares)]],
                        names=["slot", "feature", "cut", "left", "shares"])

    dealt = rows.mapInArrow(deal, "slot int, bins binary, truth binary, times binary")
    # slots are dealt in turn, where hashes would bring some together and leave other tasks without work
    found = dealt.repartitionById(min(len(about), 1024), "slot").groupBy("slot").applyInArrow(
        finish, "slot int, feature binary, cut binary, left binary, shares binary").toArrow()
    return {r["slot"]: _unpacked(r, len(plan.weights)) for r in found.to_pylist()}


def _unpacked(r: dict, classes: int) -> Trees:
    return Trees(np.frombuffer(r["feature"], np.uint16), np.frombuffer(r["cut"], np.uint8),
                 np.frombuffer(r["left"], np.int32),
                 np.frombuffer(r["shares"], np.float32).reshape(-1, classes))


@dataclass
class ForestModel:
    """Mean class shares of the leaves that a row reaches; ``active`` are the features the trees use."""

    classes: list[str]
    edges: list[np.ndarray]
    active: list[int]
    trees: list[Trees]

    @cached_property
    def nodes(self) -> list[np.ndarray]:
        return [packed(t.feature, t.cut, t.left) for t in self.trees]

    def shares(self, values: np.ndarray) -> np.ndarray:
        held = np.zeros((len(values), len(self.active) + 1), np.uint8)
        held[:, :-1] = binned(values[:, self.active], [self.edges[j] for j in self.active])
        total = np.zeros((len(values), len(self.classes)))
        for t, nodes in zip(self.trees, self.nodes, strict=True):
            total += t.shares[~t.left[descend(nodes, held)]]
        return total / total.sum(axis=1, keepdims=True)

    def probabilities(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        width = len(self.edges)
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def scored(vectors: pa.Array) -> pa.Array:
            return pa.array(list(model.value.shares(_matrix(vectors, width))), pa.list_(pa.float64()))

        return df.withColumn(out, scored(F.col(vector)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(
            [(i, *[bytearray(x.tobytes()) for x in (t.feature, t.cut, t.left, t.shares)])
             for i, t in enumerate(self.trees)],
            "tree int, feature binary, cut binary, left binary, shares binary").write.mode(
                "overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.classes, [e.tolist() for e in self.edges], self.active)],
                              "classes array<string>, edges array<array<double>>, active array<int>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        bins = spark.read.parquet(f"{path}/bins").first()
        trees = spark.read.parquet(f"{path}/trees").toArrow().sort_by("tree").to_pylist()
        return ForestModel(list(bins.classes), [np.array(e, float) for e in bins.edges], list(bins.active),
                           [_unpacked(r, len(bins.classes)) for r in trees])


def fit(rows: DataFrame, label: str, vector: str, weights: dict[str, float], trees: int, depth: int,
        seed: int, local_rows: int | None = None, batch_bytes: int | None = None) -> ForestModel:
    """``rows`` are stored; ``weights`` are those of the classes."""
    local_rows, batch_bytes = local_rows or LOCAL_ROWS, batch_bytes or BATCH_BYTES
    data = binned_blocks(rows, label, vector, BINS, lambda ids, _: ids.astype(np.int64), stored=True)
    if not data.size:
        raise ValueError("no labelled rows to fit")
    stored = len(data.active)
    place = np.full(len(data.edges), stored)
    place[data.active] = np.arange(stored)
    plan = Plan(len(data.edges), place, np.array([weights[c] for c in data.classes]), depth, seed)
    model = ForestModel(data.classes, data.edges, data.active, [])
    tops = {tree: Top() for tree in range(trees)}
    for top in tops.values():
        top.open = {0: data.size}
    small: dict[int, list[int]] = {tree: [] for tree in tops}
    while True:
        slots: dict[int, dict[int, int]] = {}
        for tree, top in tops.items():
            known = [n for n, held in top.open.items() if held > local_rows and depth]
            small[tree] += [n for n in top.open if n not in known]
            if known:
                slots[tree] = numbered(known, slots)
            top.open = {}
        if not slots:
            break
        found = _splits(data.rows, tops, slots, plan, stored)
        for tree, known in slots.items():
            top = tops[tree]
            for node, slot in known.items():
                r = found[slot]
                low, whole = np.array(r["low"], float), np.array(r["whole"], float)
                top.counts[node] = whole
                if r["gain"] <= MIN_GAIN:
                    continue
                for child in top.split(node, r["feature"], r["cut"], low, whole - low):
                    held = top.counts[child]
                    if (held > 0).sum() > 1 and top.path[child].bit_length() - 1 < depth:
                        top.open[child] = held.sum()
    size = max(1, int(batch_bytes // (data.size * (stored + 6))))
    size = -(-trees // -(-trees // size))  # batches are alike
    for start in range(0, trees, size):
        slots = {}
        for tree in range(start, min(start + size, trees)):
            if small[tree]:
                slots[tree] = numbered(small[tree], slots)
        below = _subtrees(data.rows, tops, slots, plan, stored) if slots else {}
        for tree in range(start, min(start + size, trees)):
            # a bootstrap of few rows may be empty
            own = {n: below[slot] for n, slot in slots.get(tree, {}).items() if slot in below}
            if own or tops[tree].counts[0] is not None:
                model.trees.append(tops[tree].joined(own, plan.weights))
    return model


def numbered(nodes: list[int], slots: dict[int, dict[int, int]]) -> dict[int, int]:
    """Numbers for nodes, after those in ``slots``."""
    first = sum(map(len, slots.values()))
    return {n: first + i for i, n in enumerate(nodes)}

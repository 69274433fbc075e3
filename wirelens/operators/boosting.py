"""Multiclass boosted trees from gradient histograms (E5).

Features are cut into quantile bins once; the binned rows are stored in blocks, a byte per feature that
takes more than one bin; of features whose bins are the same in all rows the first is kept, which is the
one that a split would take. A round grows one tree per class from the gradients of one softmax. The upper
levels grow one after the other: every task adds up the gradients and curvatures of its rows per (tree
node, feature, bin), a group per node adds these up, and the driver picks the split; of two sisters the one
with fewer rows is summed, the other is what remains of their parent. As soon as the rows of a node fit
``LOCAL_BYTES``, they are brought together and one task grows the rest of its tree from the same histograms;
all such nodes of a round share one pass. What reaches the driver is bounded by classes, nodes, features and
bins, whatever the number of rows. Margins are stored with the rows every few rounds, so that a pass applies
few trees and a lost executor costs one pass.

Fitting ends early when no tree of a round splits: all later rounds would see the same rows with less
curvature left. Missing values and nulls count as 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.session import cut_lineage

BINS = 32
# memory of a task that grows the subtree of a node: bins three times and five numbers a row
LOCAL_BYTES = 1 << 29
# rows of a block, and of a stored partition at most; histograms are added up over fewer partitions
BLOCK_ROWS, PART_ROWS, FIT_PART_ROWS = 1 << 11, 1 << 17, 1 << 19
# rows that are led through a tree, or summed up, at a time, which fit a core's cache
PIECE_ROWS, SUM_ROWS = 1 << 13, 1 << 15
MIN_GAIN = 1e-9
# margins are stored with the rows when passes have applied so many rounds of trees anew, which costs as much
FOLD = 10


def packed(feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number per node: its left child, which the right one follows, its feature and cut. Leaves, of a
    ``left`` below 0, lead to themselves."""
    leaf = left < 0
    to = np.where(leaf, np.arange(len(left)), left).astype(np.int64)
    # no bin is above 255
    return to << 24 | np.where(leaf, 0, feature).astype(np.int64) << 8 | np.where(leaf, 255, cut)


def descend(nodes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The node in which each row of ``held`` ends; a contiguous array is not copied."""
    out = np.empty(len(held), np.int64)
    for lo in range(0, len(held), PIECE_ROWS):
        part = held[lo:lo + PIECE_ROWS]
        flat, start = part.ravel(), np.arange(len(part)) * part.shape[1]
        at = np.zeros(len(part), np.int64)
        while True:
            below = _below(nodes, at, flat, start)
            if np.array_equal(below, at):
                break
            at = below
        out[lo:lo + PIECE_ROWS] = at
    return out


def _below(nodes: np.ndarray, at: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The nodes below ``at`` of rows whose bins begin at ``start`` of ``flat``."""
    # all places exist, so they are looked up without numpy's slower check
    node = nodes.take(at, mode="clip")
    below = node >> 24
    node &= 0xFFFFFF
    below += flat.take(start + (node >> 8), mode="clip") > node.astype(np.uint8)
    return below


@dataclass
class Tree:
    """Node i goes to ``left[i]`` where its feature's bin is at most ``cut[i]``; leaves have left -1."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        first = len(self.left)
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = first, first + 1
        for column, start in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1),
                              (self.value, 0.0)):
            column.extend([start, start])
        return first, first + 1

    def packed(self) -> np.ndarray:
        return packed(*map(np.array, (self.feature, self.cut, self.left)))


# a tree's packed nodes and their values
Walk = tuple[np.ndarray, np.ndarray]


def walks(trees: list[Tree]) -> list[Walk]:
    return [(tree.packed(), np.array(tree.value)) for tree in trees]


def softmax(margins: np.ndarray, axis: int = 1) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=axis, keepdims=True))
    return odds / odds.sum(axis=axis, keepdims=True)


def add_round(margins: np.ndarray, bins: np.ndarray, trees: list[Walk]) -> None:
    """``margins`` have a row per class, ``bins`` one per table row."""
    for own, (nodes, value) in zip(margins, trees, strict=True):
        own += value.take(descend(nodes, bins), mode="clip")


def curvature(g: np.ndarray) -> np.ndarray:
    """2p(1 - p) for gradients p or p - 1."""
    size = np.abs(g)
    return np.maximum(2 * size * (1 - size), 1e-16)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    values = np.nan_to_num(values, nan=0.0)
    return np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(edges)],
                    axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def quantile_edges(rows: DataFrame, vector: str, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of all but the last bin of each feature, from one pass."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.get(vector, F.lit(j)), F.lit(0.0)), shares, 1000)
                       .alias(f"q{j}") for j in range(width)]).first()
    return [np.unique(np.array(found[j] or [0.0], float)) for j in range(width)]


def best_splits(hist: np.ndarray, ridge: float, least: float
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, cut, totals, totals up to the cut) per node of ``hist`` (node, feature, bin,
    gradient and curvature)."""
    hist = hist[..., :2]
    totals = hist[:, 0].sum(axis=1)
    low = np.cumsum(hist, axis=2)[:, :, :-1]
    high = totals[:, None, None, :] - low

    def worth(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / (x[..., 1] + ridge)

    gain = (worth(low) + worth(high) - worth(totals)[:, None, None]) / 2
    gain[(low[..., 1] < least) | (high[..., 1] < least)] = -np.inf
    # equal gains differ in their last bits by the order of addition; the first of them is taken
    flat = np.round(gain, 9).reshape(len(hist), -1)
    at = flat.argmax(axis=1)
    feature, cut = at // low.shape[2], at % low.shape[2]
    return flat.max(axis=1), feature, cut, totals, low[np.arange(len(hist)), feature, cut]


@dataclass
class BoostedModel:
    """Class probabilities from the sum of trees per class."""

    classes: list[str]
    edges: list[np.ndarray]
    rounds: list[list[Tree]]

    @cached_property
    def walks(self) -> list[list[Walk]]:
        return [walks(trees) for trees in self.rounds]

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins, out = binned(values, self.edges), np.zeros((len(self.classes), len(values)))
        for trees in self.walks:
            add_round(out, bins, trees)
        return out.T

    def probabilities(self, df: DataFrame, vector: str = "vector", out: str = "probabilities"
                      ) -> DataFrame:
        width = len(self.edges)
        if not width:  # fitted to no rows
            return df.withColumn(out, F.array(*[F.lit(1.0 / len(self.classes)) for _ in self.classes])
                                 .cast("array<double>"))
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def scored(vectors: pa.Array) -> pa.Array:
            found = softmax(model.value.margins(_matrix(vectors, width)))
            return pa.array(list(found), pa.list_(pa.float64()))

        column: Column = F.col(vector).cast("array<double>")
        return df.withColumn(out, scored(F.when(F.size(column) == width, column).otherwise(
            F.array_repeat(F.lit(0.0), width))))

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"classes": self.classes, "edges": [e.tolist() for e in self.edges],
                           "rounds": [[vars(t) for t in trees] for trees in self.rounds]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        held = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return BoostedModel(held["classes"], [np.array(e, float) for e in held["edges"]],
                            [[Tree(**t) for t in trees] for trees in held["rounds"]])


def sums(held: np.ndarray, slot: np.ndarray | None, values: list[np.ndarray | None], number: int, bins: int
         ) -> np.ndarray:
    """(slot, feature, bin, value) sums of the rows with a slot; None counts them. ``held`` has a row
    per feature; without ``slot`` all rows are in slot 0."""
    out = np.zeros((len(held), len(values), number * bins))
    for lo in range(0, held.shape[1], SUM_ROWS):
        span = slice(lo, lo + SUM_ROWS)
        part, weights = held[:, span], [None if v is None else v[span] for v in values]
        if slot is not None:
            own = slot[span]
            use = np.flatnonzero(own >= 0)
            start = own.take(use, mode="clip") * bins
            weights = [None if v is None else v.take(use, mode="clip") for v in weights]
        for column, total in zip(part, out, strict=True):
            at = column if slot is None else start + column.take(use, mode="clip")
            for v, sum_ in zip(weights, total, strict=True):
                sum_ += np.bincount(at, v, number * bins)
    return np.ascontiguousarray(out.reshape(len(held), len(values), number, bins).transpose(2, 0, 3, 1))


def grow(held: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, step: float, ridge: float,
         least: float, bins: int) -> Tree:
    """A tree of up to ``depth`` levels of splits over rows in memory. Of two children the one with
    fewer rows is summed up, the other is what remains of their parent."""
    tree, node, width = Tree(), np.zeros(len(g), np.int64), len(held)
    flat = np.ascontiguousarray(held.T).ravel()
    open_, hist = [0], sums(held, None, [g, h], 1, bins)
    tree.value[0] = leaf_value(hist[0, 0].sum(axis=0), step, ridge)
    for level in range(depth):
        gain, feature, at, totals, low = best_splits(hist, ridge, least)
        split = np.flatnonzero(gain > MIN_GAIN)
        following = []
        for i in split:
            pair = tree.split(open_[i], int(feature[i]), int(at[i]))
            for child, held_sums in zip(pair, (low[i], totals[i] - low[i]), strict=True):
                tree.value[child] = leaf_value(held_sums, step, ridge)
            following += pair
        if not following or level + 1 == depth:
            break
        nodes = tree.packed()
        for lo in range(0, len(node), SUM_ROWS):
            own = node[lo:lo + SUM_ROWS]
            own[:] = _below(nodes, own, flat, np.arange(lo, lo + len(own)) * width)
        count = np.bincount(node, minlength=len(tree.left))[following].reshape(-1, 2)
        fewer = np.arange(len(split)) * 2 + (count[:, 1] < count[:, 0])
        place = np.full(len(tree.left), -1)
        place[np.array(following)[fewer]] = np.arange(len(split))
        below = sums(held, place.take(node, mode="clip"), [g, h], len(split), bins)
        both = np.repeat(hist[split], 2, axis=0)
        both[fewer ^ 1] -= below
        both[fewer] = below
        open_, hist = following, both
    return tree


def leaf_value(totals: np.ndarray, step: float, ridge: float) -> float:
    return float(-step * totals[0] / (totals[1] + ridge))


def read_blocks(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bins with a row per feature, class codes, further bytes) of the rows of some blocks."""
    bins, truth, extra = (batch.column(i).to_pylist() for i in range(3))
    return (np.concatenate([np.frombuffer(b, np.uint8).reshape(width, -1) for b in bins], axis=1),
            np.frombuffer(b"".join(truth), np.int32), b"".join(extra))


def write_blocks(held: np.ndarray, truth: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    starts = range(0, len(truth), BLOCK_ROWS)
    return pa.RecordBatch.from_arrays(
        [pa.array([np.ascontiguousarray(held[:, i:i + BLOCK_ROWS]).tobytes() for i in starts], pa.binary()),
         *[pa.array([x[i:i + BLOCK_ROWS].tobytes() for i in starts], pa.binary()) for x in (truth, extra)]],
        ["bins", "truth", "extra"])


BLOCKS = "bins binary, truth binary, extra binary"


def _margins(batch: pa.RecordBatch, recent: list[list[Walk]], width: int, classes: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins with a row per feature, with a row per table row, class codes, margins with a row per class)
    of a batch of stored blocks."""
    held, truth, extra = read_blocks(batch, width)
    margins = np.frombuffer(extra).reshape(-1, classes).T.copy()
    by_row = np.ascontiguousarray(held.T)
    for trees in recent:
        add_round(margins, by_row, trees)
    return held, by_row, truth, margins


def _gradients(batch: pa.RecordBatch, recent: list[list[Walk]], width: int, classes: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins with a row per feature, with a row per table row, gradients with a row per class)."""
    held, by_row, truth, margins = _margins(batch, recent, width, classes)
    g = softmax(margins, axis=0)
    g[truth, np.arange(len(truth))] -= 1
    return held, by_row, g


def _histograms(rows: DataFrame, recent: list[list[Walk]], growing: list[Tree], slots: list[dict[int, int]],
                width: int, bins: int) -> list[np.ndarray]:
    """(feature, bin, 3) sums of gradients, curvatures and rows of every numbered node; ``slots`` number the
    nodes of each tree."""
    places = [_places(tree, known) for tree, known in zip(growing, slots, strict=True)]
    # slots of a tree follow one another
    firsts = [min(known.values(), default=0) for known in slots]
    nodes, numbers = [tree.packed() for tree in growing], list(map(len, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, by_row, g = _gradients(batch, recent, width, len(nodes))
            for k, number in enumerate(numbers):
                if not number:
                    continue
                slot = None
                if len(nodes[k]) > 1:
                    slot = places[k].take(descend(nodes[k], by_row), mode="clip")
                    slot = np.where(slot < 0, -1, slot - firsts[k])
                hist = sums(held, slot, [g[k], curvature(g[k]), None], number, bins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(firsts[k], firsts[k] + number), pa.int32()),
                     pa.array([x.tobytes() for x in hist], pa.binary())], ["slot", "hist"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column(1))
        return pa.table([table.column(0)[:1], pa.array([total.tobytes()], pa.binary())], names=["slot", "hist"])

    found = rows.mapInArrow(run, "slot int, hist binary").repartitionById(sum(numbers), "slot").groupBy(
        "slot").applyInArrow(add, "slot int, hist binary").toArrow().sort_by("slot")
    return [np.frombuffer(x).reshape(width, bins, 3) for x in found.column(1).to_pylist()]


def _places(tree: Tree, known: dict[int, int]) -> np.ndarray:
    place = np.full(len(tree.left), -1)
    for node, slot in known.items():
        place[node] = slot
    return place


_SUBTREE = ("slot int, feature array<int>, cut array<int>, left array<int>, right array<int>, "
            "value array<double>")


def deal_slots(slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, its rows) of every slot that rows have; -1 is none."""
    # short numbers are sorted by their digits
    order = np.argsort(slot.astype(np.int16 if slot.max() < 1 << 15 else np.int32), kind="stable")
    found, first = np.unique(slot[order], return_index=True)
    for number, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        if number >= 0:
            yield number, own


def _subtrees(rows: DataFrame, recent: list[list[Walk]], growing: list[Tree],
              slots: list[dict[int, int]], left: list[int], width: int, settings: tuple
              ) -> dict[int, Tree]:
    """The rest of the tree below every numbered node, ``left`` levels each, by number."""
    places = [_places(tree, known) for tree, known in zip(growing, slots, strict=True)]
    nodes = [tree.packed() for tree in growing]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, by_row, g = _gradients(batch, recent, width, len(nodes))
            for k, place in enumerate(places):
                if len(place) == 1:
                    parts = [(int(place[0]), held, g[k])] if place[0] >= 0 else []
                else:
                    parts = ((slot, held.take(own, axis=1, mode="clip"), g[k].take(own, mode="clip"))
                             for slot, own in deal_slots(place.take(descend(nodes[k], by_row), mode="clip")))
                # one record per slot, not per row
                for slot, *own in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([slot], pa.int32()),
                         *[pa.array([x.tobytes()], pa.binary()) for x in own]], ["slot", "bins", "g"])

    def finish(table: pa.Table) -> pa.Table:
        slot = table.column(0)[0].as_py()
        held = np.concatenate([np.frombuffer(b, np.uint8).reshape(width, -1)
                               for b in table.column(1).to_pylist()], axis=1)
        g = np.frombuffer(b"".join(table.column(2).to_pylist()))
        tree = grow(held, g, curvature(g), left[slot], *settings)
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (
            tree.feature, tree.cut, tree.left, tree.right)]
        return pa.table([pa.array([slot], pa.int32()), *lists,
                         pa.array([tree.value], pa.list_(pa.float64()))],
                        names=[part.split()[0] for part in _SUBTREE.split(", ")])

    # a partition per slot, where hashes would bring some together and leave other tasks without work
    dealt = rows.mapInArrow(deal, "slot int, bins binary, g binary").repartitionById(
        len(left), "slot")
    return {r["slot"]: Tree(r["feature"], r["cut"], r["left"], r["right"], r["value"])
            for r in dealt.groupBy("slot").applyInArrow(finish, _SUBTREE).toArrow().to_pylist()}


def attach(tree: Tree, node: int, below: Tree) -> None:
    """Put ``below`` in the place of a leaf."""
    first = len(tree.left) - 1

    def moved(i: int) -> int:
        return i if i < 0 else node if i == 0 else first + i

    for column, new in ((tree.feature, below.feature), (tree.cut, below.cut),
                        (tree.left, [moved(i) for i in below.left]),
                        (tree.right, [moved(i) for i in below.right]), (tree.value, below.value)):
        column[node] = new[0]
        column.extend(new[1:])


def _folded(rows: DataFrame, recent: list[list[Walk]], width: int, classes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held, _, truth, margins = _margins(batch, recent, width, classes)
                yield write_blocks(held, truth, np.ascontiguousarray(margins.T))

    return cut_lineage(rows.mapInArrow(run, BLOCKS))


@dataclass
class Binned:
    """Labelled rows in blocks; ``active`` are the features that take more than one bin."""

    classes: list[str]
    edges: list[np.ndarray]
    active: list[int]
    size: int
    rows: DataFrame | None

    def features_of(self, tree: Tree) -> Tree:
        """A tree over the stored features as one over all."""
        return Tree([self.active[f] for f in tree.feature], tree.cut, tree.left, tree.right, tree.value)


def binned_blocks(df: DataFrame, label: str, vector: str, bins: int,
                  extra: Callable[[np.ndarray, int], np.ndarray], stored: bool = False,
                  part_rows: int = PART_ROWS) -> Binned:
    """``extra`` makes the third column of the blocks of row numbers and the number of classes. Rows that
    are ``stored`` are not written before several passes read them."""
    rows = df.select(F.col(label).cast("string").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    if not stored:
        rows = cut_lineage(rows)
    classes = [r[0] for r in rows.select("label").where("label is not null").distinct()
               .orderBy("label").collect()]
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if width < 1 or not classes:
        return Binned(classes, [], [], 0, None)
    edges = quantile_edges(rows, "vector", width, bins)
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    used = rows.where(F.col("label").isNotNull() & (F.size("vector") == width)).select(
        "vector", code.cast("int").alias("truth"), F.monotonically_increasing_id().alias("number"))
    value = [F.nanvl(F.coalesce(F.get("vector", F.lit(j)), F.lit(0.0)), F.lit(0.0)) for j in range(width)]
    size, low, high = used.agg(F.count(F.lit(1)), F.array(*map(F.min, value)),
                               F.array(*map(F.max, value))).first()
    if not size:
        return Binned(classes, edges, [], 0, None)
    low, high = (binned(np.array([x], float), edges)[0] for x in (low, high))
    active = np.flatnonzero(low < high).tolist() or [0]
    number = len(classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = binned(_matrix(batch.column(0), width), edges)[:, active].T
                yield write_blocks(held, batch.column(1).to_numpy(),
                                   extra(batch.column(2).to_numpy(), number))

    # a task's histograms are as large for few rows as for many, so there are no more tasks than needed
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_rows))
    blocks = used.mapInArrow(cut, BLOCKS).repartition(min(parts, -(-size // BLOCK_ROWS)))
    return Binned(classes, edges, active, size, cut_lineage(blocks))


def without_twins(data: Binned) -> Binned:
    """Without the stored features whose bins are those of an earlier one in all rows: sums and gains would
    be the same, and of equal gains the first is taken."""
    width = len(data.active)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen: dict[bytes, int] = {}
                found = [seen.setdefault(column.tobytes(), j) for j, column in enumerate(read_blocks(batch, width)[0])]
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.int32()))], ["first"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.frombuffer(b, np.uint8).reshape(width, -1)[kept].tobytes()
                    for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), batch.column(1), batch.column(2)],
                                             batch.schema.names)

    found = data.rows.mapInArrow(firsts, "first array<int>").distinct().collect()
    # features are equal in all rows if they are in every batch
    seen: dict[tuple, int] = {}
    for j in range(width):
        seen.setdefault(tuple(r[0][j] for r in found), j)
    kept = list(seen.values())
    if len(kept) == width:
        return data
    return replace(data, active=[data.active[j] for j in kept], rows=cut_lineage(data.rows.mapInArrow(cut, BLOCKS)))


def sister(node: int) -> int:
    """The other child of a node's parent; the root's is itself."""
    return ((node - 1) ^ 1) + 1 if node else 0


def fit(df: DataFrame, label: str, vector: str, rounds: int = 200, depth: int = 8, step: float = 0.1,
        ridge: float = 1.0, least: float = 1.0, bins: int = BINS, local_rows: int | None = None
        ) -> BoostedModel:
    """Trees for all classes of ``label``; ``vector`` holds arrays of one length."""
    data = binned_blocks(df, label, vector, bins, lambda ids, classes: np.zeros((len(ids), classes)),
                         part_rows=FIT_PART_ROWS)
    model, recent, walked = BoostedModel(data.classes, data.edges, []), [], 0
    if not data.size:
        return model
    data = without_twins(data)
    classes, size, stored, width = data.classes, data.size, data.rows, len(data.active)
    local_rows = local_rows or LOCAL_BYTES // (3 * width + 40)
    settings = (step, ridge, least, bins)
    for _ in range(rounds):
        growing = [Tree() for _ in classes]
        open_: list[dict[int, float]] = [{0: size} for _ in classes]  # rows of the open nodes
        parents: list[dict[int, np.ndarray]] = [{} for _ in classes]  # sums of the open nodes' parents
        small: list[dict[int, int]] = [{} for _ in classes]
        levels: list[int] = []
        for level in range(max(depth, 1)):
            large: list[tuple[int, int]] = []
            slots: list[dict[int, int]] = [{} for _ in classes]
            for k, nodes in enumerate(open_):
                for node, held in nodes.items():
                    if held <= local_rows:
                        small[k][node] = len(levels)
                        levels.append(depth - level)
                    else:
                        large.append((k, node))
                        slots[k].setdefault(min(node, sister(node), key=nodes.get), sum(map(len, slots)))
            if not large:
                break
            found = _histograms(stored, recent, growing, slots, width, bins)
            walked += len(recent)
            hist = np.stack([found[slots[k][node]] if node in slots[k]
                             else parents[k][node] - found[slots[k][sister(node)]] for k, node in large])
            open_, parents = [{} for _ in classes], [{} for _ in classes]
            for (k, node), sums_, gain, feature, at, totals, low in zip(
                    large, hist, *best_splits(hist, ridge, least), strict=True):
                tree = growing[k]
                tree.value[node] = leaf_value(totals, step, ridge)
                if gain > MIN_GAIN and level < depth:
                    children = tree.split(node, int(feature), int(at))
                    counts = sums_[feature, :, 2]
                    for child, held, rows in zip(children, (low, totals - low), (
                            counts[:at + 1].sum(), counts[at + 1:].sum()), strict=True):
                        tree.value[child] = leaf_value(held, step, ridge)
                        open_[k][child], parents[k][child] = rows, sums_
        if levels:
            below = _subtrees(stored, recent, growing, small, levels, width, settings)
            walked += len(recent)
            for k, known in enumerate(small):
                for node, slot in known.items():
                    attach(growing[k], node, below[slot])
        model.rounds.append([data.features_of(tree) for tree in growing])
        recent.append(walks(growing))
        if all(len(tree.left) == 1 for tree in growing):
            break
        if walked >= FOLD:
            stored, recent, walked = _folded(stored, recent, width, len(classes)), [], 0
    return model

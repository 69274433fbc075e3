"""Isolation forest (E1-E3): sampled, grown on executors, scored in Arrow batches.

Liu, Ting and Zhou, "Isolation Forest", 2008. Every tree sees at most 256 rows, so the growing step
handles a constant amount of data whatever the table holds. All random choices come from hashes of
the row id and the tree number, so a refit on the same rows gives the same forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.operators.scoring import anomaly_score
from wirelens.session import cut_lineage

_EULER = 0.5772156649
NODES = ("tree int, node int, feature int, threshold double, left int, right int, size long")
# the offset's rank is off by at most rows / this
_QUANTILE_ACCURACY = 1_000_000
# the least draws of a tree are merged in this many groups before they meet
_MERGE_GROUPS = 64
# rows scored at a time, which fit a core's cache
_SCORED_ROWS = 1 << 12


def tree_draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """One pseudo-random 64-bit number per row key for a tree (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def least_draws(trees: int, sample: int):
    """Batches of (id, key) -> the ``sample`` rows with the least draws of every tree."""

    def run(batches):
        ids: list = [None] * trees
        draws = [np.empty(0, dtype="uint64")] * trees
        for pdf in batches:
            keys = pdf["key"].to_numpy().astype("int64").view("uint64")
            own = pdf["id"].to_numpy()
            for tree in range(trees):
                new = tree_draws(keys, tree)
                merged = np.concatenate([draws[tree], new])
                names = own if ids[tree] is None else np.concatenate([ids[tree], own])
                if len(merged) > sample:
                    least = np.argpartition(merged, sample - 1)[:sample]
                    merged, names = merged[least], names[least]
                draws[tree], ids[tree] = merged, names
        for tree in range(trees):
            if ids[tree] is not None:
                # the flipped top bit makes signed order equal to unsigned order
                order = (draws[tree] ^ np.uint64(1 << 63)).view("int64")
                yield pd.DataFrame({"tree": np.int32(tree), "id": ids[tree], "draw": order})

    return run


def path_constant(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 3)
    general = 2 * (np.log(big - 1) + _EULER) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def grow_tree(x: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Random splits down to depth ceil(log2 n); nodes in level order."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    pending = [(x, 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop(0)
        here = len(nodes)
        if parent >= 0:
            nodes[parent][4 + is_right] = here
        nodes.append([tree, here, -1, 0.0, -1, -1, len(rows)])
        if depth >= limit or len(rows) < 2:
            continue
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        rng = np.random.default_rng([seed, tree, here])
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= cut
        if goes_left.all():
            # the draw hit the upper end; keep both sides non-empty
            cut = float(np.nextafter(high[feature], low[feature]))
            goes_left = rows[:, feature] <= cut
        nodes[here][2:4] = [feature, cut]
        pending.append((rows[goes_left], depth + 1, here, False))
        pending.append((rows[~goes_left], depth + 1, here, True))
    return [tuple(n) for n in nodes]


def forest_arrays(nodes: pd.DataFrame, sample_size: int) -> dict:
    """All trees as flat node arrays, plain values that any worker can read."""
    nodes = nodes.sort_values(["tree", "node"])
    first = nodes.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(first).to_numpy()
    feature = nodes["feature"].to_numpy()
    leaf = feature < 0
    own = base + nodes["node"].to_numpy()
    # leaves lead to themselves, so all rows can take the same number of steps
    left = np.where(leaf, own, base + nodes["left"].to_numpy())
    right = np.where(leaf, own, base + nodes["right"].to_numpy())
    depth = np.zeros(len(nodes))
    for i in np.flatnonzero(~leaf):
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    return {
        "roots": first.to_numpy(), "feature": np.maximum(feature, 0),
        "children": np.stack([left, right], axis=1).ravel(), "threshold": nodes["threshold"].to_numpy(),
        "path": depth + path_constant(nodes["size"].to_numpy()),
        "steps": int(depth.max()) if len(depth) else 0,
        "norm": float(path_constant(sample_size))}


def forest_score(forest: dict, x: np.ndarray) -> np.ndarray:
    """-2^(-E[h]/c): close to -1 for outliers, above -0.5 for ordinary rows."""
    total = np.zeros(len(x))
    if len(x) and forest["feature"].max(initial=0) >= x.shape[1]:
        raise IndexError(f"rows have {x.shape[1]} values, the forest reads more")
    for first in range(0, len(x), _SCORED_ROWS):
        part = np.ascontiguousarray(x[first:first + _SCORED_ROWS], float)
        flat, start = part.ravel(), np.arange(len(part)) * part.shape[1]
        for root in forest["roots"]:
            at = np.full(len(part), root)
            # all places exist now, so they are looked up without numpy's slower check
            for _ in range(forest["steps"]):
                value = flat.take(start + forest["feature"].take(at, mode="clip"), mode="clip")
                go_left = value <= forest["threshold"].take(at, mode="clip")
                at *= 2
                at += ~go_left
                at = forest["children"].take(at, mode="clip")
            total[first:first + _SCORED_ROWS] += forest["path"].take(at, mode="clip")
    mean = total / max(len(forest["roots"]), 1)
    if not forest["norm"]:
        return np.full(len(x), -0.5)
    return -np.power(2.0, -mean / forest["norm"])


@dataclass
class IsolationForestModel:
    """Node table of at most trees x (2 x sample - 1) rows, held on the driver and broadcast."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float

    def raw_score(self, spark: SparkSession, vector: Column) -> Column:
        shared = spark.sparkContext.broadcast(forest_arrays(self.nodes, self.sample_size))

        @F.pandas_udf(T.DoubleType())
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            return pd.Series(forest_score(shared.value, np.stack(v.to_numpy())))

        return score(vector)

    def decision(self, spark: SparkSession, vector: Column) -> Column:
        """Negative for outliers."""
        return self.raw_score(spark, vector) - F.lit(self.offset)

    def transform(self, df: DataFrame, vector: Column, out: str = "anomaly_score") -> DataFrame:
        """Add the 0..1 anomaly score."""
        return df.withColumn(out, anomaly_score(self.decision(df.sparkSession, vector)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as parquet, scalars beside them."""
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/nodes")
        spark.createDataFrame([(self.sample_size, self.offset)], "sample_size int, offset double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/scalars")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        scalars = spark.read.parquet(f"{path}/scalars").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return IsolationForestModel(nodes, scalars["sample_size"], scalars["offset"])


@dataclass
class IsolationForest:
    trees: int = 100
    contamination: float = 0.1
    seed: int = 42
    sample: int = 256

    def _drawn(self, data: DataFrame) -> DataFrame:
        """(tree, id) of the rows every tree grows on: those with its least draws, over all rows.

        A map task keeps at most trees x sample rows and sends only ids; they are ranked in groups
        first, so no task ranks the rows of all map tasks.
        """
        keyed = data.select("id", F.xxhash64("id", F.lit(self.seed)).alias("key"))
        kept = keyed.mapInPandas(
            least_draws(self.trees, self.sample),
            T.StructType([T.StructField("tree", T.IntegerType()), data.schema["id"],
                          T.StructField("draw", T.LongType())]))
        group = F.pmod(F.xxhash64("draw"), F.lit(_MERGE_GROUPS))
        for keys in (["tree", group], ["tree"]):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "id"))
            kept = kept.withColumn("_rank", rank).filter(F.col("_rank") <= self.sample)
        return kept.select("tree", "id")

    def fit(self, df: DataFrame, row_id: str, vector: Column) -> IsolationForestModel:
        """``row_id`` must identify rows; ``vector`` is an array<double> column."""
        spark = df.sparkSession
        # drawn from, joined and scored: three passes over rows that are written once
        data = cut_lineage(df.select(F.col(row_id).alias("id"), vector.alias("v")))
        # at most trees x sample ids, so the broadcast has a fixed bound
        drawn = data.join(F.broadcast(self._drawn(data)), "id")
        seed = self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            nodes = grow_tree(np.stack(pdf["v"].to_numpy()), int(pdf["tree"].iloc[0]), seed)
            return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left",
                                                "right", "size"])

        nodes = drawn.groupBy("tree").applyInPandas(grow, NODES).toPandas().sort_values(
            ["tree", "node"], ignore_index=True)
        # every tree has the same number of rows: the sample, or all of a smaller table
        size = int(nodes.loc[nodes["node"] == 0, "size"].max()) if len(nodes) else 0
        model = IsolationForestModel(nodes, size, 0.0)
        if size:
            scored = data.select(model.raw_score(spark, F.col("v")).alias("s"))
            model.offset = float(scored.agg(F.percentile_approx(
                "s", F.lit(self.contamination), F.lit(_QUANTILE_ACCURACY)).alias("o")).first()["o"])
        return model

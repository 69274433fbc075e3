"""Attack classifier, sequence classifier, splits and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.fixed_values import FEATURE_NAMES
from wirelens.operators import boosting, forest
from wirelens.operators.ordered import null_safe_join
from wirelens.operators.scoring import classify
from wirelens.session import cut_lineage


def label_index(labels: DataFrame, label: str = "label", out: str = "label_index") -> DataFrame:
    """Alphabetical integer codes."""
    indexer = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc")
    return indexer.fit(labels).transform(labels).withColumn(out, F.col(out).cast("int"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class), one row per class."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    over = Window.partitionBy(F.lit(0))  # one row per class
    return per_class.withColumn("weight", F.sum("class_count").over(over).cast("double")
                                / (F.count(F.lit(1)).over(over) * F.col("class_count")))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """One row per class goes to every task, so that a dominant class is not shuffled."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)


def scaling_stats(df: DataFrame, columns: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Mean and population deviation per feature in long form, from one pass."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns
                     for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__std").alias("std")) for c in columns])
    return stats.select(F.inline(rows))


# rows of a class among which the last row of its training part is found by ranking
_RANKED = 100_000
_CELL_BITS = 12


def split_cuts(df: DataFrame, label: str, row_id: str, train_share: float, seed: int) -> DataFrame:
    """(label, _quota, _cut_h, _cut_id): the last training row of each class in the order of hash and
    id. The hash range that holds it is narrowed by counts per cell, one pass per 12 bits, until few rows
    are left to rank."""
    hashed = df.select(F.col(label).alias("_label"), F.col(row_id).alias("_id"),
                       F.xxhash64(F.col(row_id), F.lit(seed)).alias("_h"))
    # unsigned order by the top bits first; one row per class
    state = cut_lineage(hashed.groupBy("_label").agg(F.count(F.lit(1)).alias("_held")).select(
        "_label", "_held", F.floor(F.col("_held") * train_share + 0.5).alias("_left"),
        F.floor(F.col("_held") * train_share + 0.5).alias("_quota"), F.lit(0).cast("long").alias("_prefix")))
    shift = 64
    while True:
        inside = null_safe_join(hashed, F.broadcast(state), ["_label"]).where("_left > 0")
        if shift < 64:
            inside = inside.where(F.shiftrightunsigned("_h", shift) == F.col("_prefix"))
        if shift < _CELL_BITS or (state.agg(F.max("_held")).first()[0] or 0) <= _RANKED:
            break
        shift -= _CELL_BITS
        cells = inside.groupBy("_label", "_left", "_quota", F.shiftrightunsigned("_h", shift)
                               .alias("_prefix")).agg(F.count(F.lit(1)).alias("_held"))
        upto = F.sum("_held").over(Window.partitionBy("_label").orderBy("_prefix"))
        state = cut_lineage(cells.withColumn("_upto", upto).where(
            (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_held") < F.col("_left")))
            .select("_label", "_held", (F.col("_left") - F.col("_upto") + F.col("_held")).alias("_left"),
                    "_quota", "_prefix"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(_unsigned("_h"), "_id"))
    return cut_lineage(inside.withColumn("_rank", rank).where("_rank = _left").select(
        "_label", _unsigned("_h").alias("_cut_h"), F.col("_id").alias("_cut_id")))


def _unsigned(h: str) -> Column:
    """A 64-bit hash in its unsigned order."""
    return F.col(h).bitwiseXOR(F.lit(-(2 ** 63)))


def stratified_split(df: DataFrame, label: str, row_id: str, train_share: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Add ``is_train``, exactly round(share * n) rows of every class.

    Rows are ordered by a hash of ``row_id``, which must be unique, within their class. Only the cut of
    each class is worked out beforehand; the split itself compares each row with one row per class
    and moves none. A null label is a class of its own.
    """
    cuts = split_cuts(df, label, row_id, train_share, seed)
    rows = df.withColumns({"_label": F.col(label), "_h": F.xxhash64(F.col(row_id), F.lit(seed))})
    h, cut = _unsigned("_h"), F.col("_cut_h")
    chosen = (h < cut) | ((h == cut) & (F.col(row_id) <= F.col("_cut_id")))
    return (null_safe_join(rows, F.broadcast(cuts), ["_label"], "left")
            .select(*df.columns, F.coalesce(chosen, F.lit(False)).alias("is_train")))


@dataclass
class AttackClassifier:
    """Scaled features -> class probabilities."""

    trees: int = 200
    depth: int = 15
    boosted: bool = False
    rounds: int = 200
    boost_depth: int = 8
    step: float = 0.1
    seed: int = 42
    scale: bool = True

    def fit(self, df: DataFrame, label: str = "label", vector: str = "vector"
            ) -> "AttackClassifierModel":
        """``vector`` is an array<double> column. Boosting takes no class weights, as before, and cuts
        features into quantile bins, which scaling would not change."""
        if self.boosted:
            return AttackClassifierModel(boosting.fit(
                df, label, vector, self.rounds, self.boost_depth, self.step))
        # several passes follow, so the rows are written once instead of being derived each time
        rows = cut_lineage(df.select(F.col(label).alias("label"),
                                     array_to_vector(vector).alias("raw")))
        rows = with_class_weights(rows)
        scaler = StandardScaler(inputCol="raw", outputCol="scaled",
                                withMean=self.scale, withStd=self.scale)
        indexer = StringIndexer(inputCol="label", outputCol="label_index",
                                stringOrderType="alphabetAsc")
        prepared = Pipeline(stages=[indexer, scaler]).fit(rows)
        weights = {r.label: r.weight for r in
                   rows.groupBy("label").agg(F.max("weight").alias("weight")).collect()}
        scaled = prepared.transform(rows).select("label", vector_to_array("scaled").alias("scaled"))
        return AttackClassifierModel(prepared, forest.fit(
            scaled, "label", "scaled", weights, self.trees, self.depth, self.seed))


@dataclass
class AttackClassifierModel:
    """Boosted trees, or label codes and scaling with the forest behind them."""

    fitted: PipelineModel | boosting.BoostedModel
    trees: forest.ForestModel | None = None

    @property
    def classes(self) -> list[str]:
        if isinstance(self.fitted, boosting.BoostedModel):
            return self.fitted.classes
        indexer = next(s for s in self.fitted.stages if isinstance(s, StringIndexerModel))
        return list(indexer.labels)

    def probabilities(self, df: DataFrame, vector: str = "vector",
                      out: str = "probabilities") -> DataFrame:
        if isinstance(self.fitted, boosting.BoostedModel):
            return self.fitted.probabilities(df, vector, out)
        scored = df.withColumn("raw", array_to_vector(vector))
        for stage in self.fitted.stages[1:]:
            scored = stage.transform(scored)
        scored = scored.withColumn("scaled", vector_to_array("scaled"))
        return self.trees.probabilities(scored, "scaled", out).drop("raw", "scaled")

    def transform(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """E6 on top of the model."""
        return classify(self.probabilities(df, vector), "probabilities", self.classes)

    def save(self, path: str) -> None:
        """The class list travels inside the label indexer or the boosted model."""
        if isinstance(self.fitted, boosting.BoostedModel):
            self.fitted.save(SparkSession.active(), path)
        else:
            self.fitted.write().overwrite().save(path)
            self.trees.save(SparkSession.active(), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AttackClassifierModel":
        stages = spark._jvm.org.apache.hadoop.fs.Path(path, "stages")
        if stages.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stages):
            return AttackClassifierModel(PipelineModel.load(path), forest.ForestModel.load(spark, path))
        return AttackClassifierModel(boosting.BoostedModel.load(spark, path))


def fit_sequence_classifier(windows: DataFrame, width: int, length: int = 10, rounds: int = 10,
                            seed: int = 42) -> PipelineModel:
    """Feed-forward net 64-32-16 over flattened sequence windows (``sequence``, ``target``).

    The recurrent original is a single-machine net; this is its distributed counterpart.
    """
    scaler = StandardScaler(inputCol="flat", outputCol="scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(
        layers=[width * length, 64, 32, 16, 2], maxIter=rounds, seed=seed,
        featuresCol="scaled", labelCol="target", predictionCol="predicted")
    rows = cut_lineage(flatten_windows(windows).select("flat", "target"))
    return Pipeline(stages=[scaler, net]).fit(rows)


def flatten_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumn("flat", array_to_vector(F.flatten("sequence")))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction"
                          ) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy and averages.

    Rows are reduced to the confusion matrix first; everything after it has one row per class.
    """
    pairs = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("c")).otherwise(0)
    actual = pairs.groupBy(F.col(label).alias("class")).agg(
        F.sum("c").alias("support"), F.sum(hit).alias("hits"))
    claimed = pairs.groupBy(F.col(prediction).alias("class")).agg(F.sum("c").alias("claimed"))
    joined = actual.join(claimed, "class", "full").na.fill(0, ["support", "hits", "claimed"])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision = ratio(F.col("hits"), F.col("claimed"))
    recall = ratio(F.col("hits"), F.col("support"))
    per_class = joined.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "support", "hits")
    total = F.sum("support")
    metrics = ("precision", "recall", "f1")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    accuracy = F.sum("hits") / total
    summary = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"),
                 *[accuracy.alias(m) for m in metrics], total.alias("support")),
        F.struct(F.lit("macro avg").alias("class"),
                 *[F.avg(m).alias(m) for m in metrics], total.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 *[weighted(m).alias(m) for m in metrics], total.alias("support"))).alias("rows"))
    return per_class.drop("hits").unionByName(summary.select(F.inline("rows")))

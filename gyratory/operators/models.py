"""Classifiers on the forecasting table (H16-H20): forests and perceptrons of Spark ML, the booster and the balanced ensembles of this library."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gyratory.functions.ordered import checked_broadcast
from gyratory.operators.boosting import Booster, fit_booster
from gyratory.operators.ensembles import Ensemble
from gyratory.operators.metrics import class_weights, confusion_matrix, per_class_prf, summary_scores

LABEL, WEIGHT = "label", "weight"

CATEGORIES = {"random_forest": "Random Forest", "boosted_trees": "Gradient Boosting", "mlp": "Neural Network", "balanced_bag": "Bagging", "balanced_boost": "Boosting with Sampling"}


def with_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weights beside every row (one weight per class)."""
    weights = class_weights(df, label).select(label, "weight")
    return df.join(checked_broadcast(weights), label)


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_random_forest(
    df: DataFrame, features: Sequence[str], trees: int = 200, depth: int = 15, weighted: bool = True, seed: int = 42
) -> PipelineModel:
    """H16"""
    rows = with_weights(df) if weighted else df
    forest = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    if weighted:
        forest = forest.setWeightCol(WEIGHT)
    return Pipeline(stages=[_assembled(features), forest]).fit(rows)


def train_boosted_trees(
    df: DataFrame, features: Sequence[str], rounds: int = 200, depth: int = 5, rate: float = 0.1, subsample: float = 0.8,
    weights: dict[int, float] | None = None, seed: int = 42,
) -> Booster:
    """One softmax booster over all classes, balanced class weights unless others are given."""
    return fit_booster(df, features, LABEL, weights, rounds, depth, rate, subsample, seed=seed)


def train_mlp(
    df: DataFrame, features: Sequence[str], classes: int, hidden: Sequence[int] = (128, 64), iterations: int = 100, seed: int = 42
) -> PipelineModel:
    """A perceptron on scaled features."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    net = MultilayerPerceptronClassifier(
        labelCol=LABEL, featuresCol="scaled", layers=[len(features), *hidden, classes], maxIter=iterations, seed=seed
    )
    return Pipeline(stages=[_assembled(features), scaler, net]).fit(df)


def probabilities(model: PipelineModel | Booster | Ensemble, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, probs, y_pred) of any model: its class probabilities and the likeliest class."""
    if not isinstance(model, PipelineModel):
        return model.probabilities(df, keys)
    out = model.transform(df)
    return out.select(*keys, vector_to_array("probability").alias("probs"), F.col("prediction").cast("int").alias("y_pred"))


def predict(model: PipelineModel | Booster | Ensemble, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted class per row, with the true class."""
    rows = df.withColumn("y_true", F.col(LABEL).cast("int"))
    return probabilities(model, rows, [*keys, "y_true"]).select(*keys, "y_true", "y_pred")


def score(model: PipelineModel | Booster | Ensemble, df: DataFrame) -> DataFrame:
    """H4 and H5 of a model, as one row."""
    scores = summary_scores(per_class_prf(confusion_matrix(predict(model, df, []))))
    return scores.withColumn("score", 0.7 * F.col("macro_f1") + 0.3 * F.col("accuracy"))


def compare_models(
    train: DataFrame, valid: DataFrame, trainers: dict[str, Callable[[DataFrame], PipelineModel | Booster | Ensemble]], at_once: int = 2
) -> DataFrame:
    """Fit each, score on the validation rows, rank. One row per model reaches the driver; a model that fails ends the comparison.

    `at_once` models are fitted at the same time, since boosters and perceptrons are many short passes that leave cores idle; the driver holds
    the trees and histograms of no more. Fits that run when one fails are waited for.
    """
    spark = train.sparkSession

    def one(fit: Callable[[DataFrame], PipelineModel | Booster | Ensemble]) -> Row:
        return score(fit(train), valid).first()

    with ThreadPoolExecutor(at_once) as pool:
        # each thread gets a copy of the local properties of its own
        fitted = [pool.submit(inheritable_thread_target(spark)(one), fit) for fit in trainers.values()]
    rows = [(name, CATEGORIES.get(name, "Other"), *[float(v) for v in scores.result()]) for name, scores in zip(trainers, fitted, strict=True)]
    schema = "model string, category string, macro_f1 double, weighted_f1 double, accuracy double, balanced_accuracy double, score double"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("score"), "model")


def category_stats(results: DataFrame) -> DataFrame:
    """Mean, best and worst score per model family."""
    return results.groupBy("category").agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.min("score").alias("worst_score"),
        F.count(F.lit(1)).alias("models"),
    )


def feature_importance(model: PipelineModel | Booster, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Importances of a tree ensemble, largest first."""
    found = model.importance() if isinstance(model, Booster) else zip(features, map(float, model.stages[-1].featureImportances.toArray()))
    rows = sorted(found, key=lambda r: (-r[1], r[0]))[:top]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")

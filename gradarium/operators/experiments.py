"""Grids of settings: fit, score and time several classifiers on each data set, results as one tidy table."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradarium.functions.expressions import clean_name, experiment_code
from gradarium.functions.ordering import written
from gradarium.operators.boosting import BoostedBins
from gradarium.operators.metrics import max_ratios
from gradarium.operators.trees import LeafwiseTrees
from gradarium.sources.readers import random_matrix

SCHEMA = "data_name string, classifier string, rounds int, n_bins int, metric string, value double"

#: (rows with y -1 or 1, array column of features, rounds, bins) -> a function that adds the column prediction.
Classifier = Callable[[DataFrame, str, int, int], Callable[[DataFrame], DataFrame]]


def boosted_bins(train: DataFrame, x: str, rounds: int, n_bins: int) -> Callable[[DataFrame], DataFrame]:
    return BoostedBins(rounds=rounds, n_bins=n_bins).fit(train, "y", x).transform


def leafwise_trees(train: DataFrame, x: str, rounds: int, n_bins: int) -> Callable[[DataFrame], DataFrame]:
    """Gradient boosting of trees of up to 31 leaves over n_bins bins (2 at least), grown leaf by leaf."""
    model = LeafwiseTrees(rounds=rounds, n_bins=max(2, n_bins)).fit(train, "y", x)
    return lambda df: model.transform(df).drop("score")


def _vectors(df: DataFrame, x: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__x", array_to_vector(F.col(x).cast("array<double>"))).withColumn("__y", (F.col("y") > 0).cast("double"))


def _without(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop("__x", "__y", "rawPrediction", "probability", *columns)


def boosted_stumps(train: DataFrame, x: str, rounds: int, n_bins: int) -> Callable[[DataFrame], DataFrame]:
    """Gradient boosting of trees of depth 1 from Spark's library, over n_bins bins (2 at least)."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(labelCol="__y", featuresCol="__x", maxDepth=1, maxIter=rounds, maxBins=max(2, n_bins), seed=0).fit(_vectors(train, x))
    return lambda df: _without(model.transform(_vectors(df, x)).withColumn("prediction", (F.col("prediction") * 2 - 1).cast("int")))


def boosted_trees(train: DataFrame, x: str, rounds: int, n_bins: int) -> Callable[[DataFrame], DataFrame]:
    """Gradient boosting of trees of depth 3 over histograms of n_bins bins, from Spark's library."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(labelCol="__y", featuresCol="__x", maxDepth=3, maxIter=rounds, maxBins=max(2, n_bins), seed=0).fit(_vectors(train, x))
    return lambda df: _without(model.transform(_vectors(df, x)).withColumn("prediction", (F.col("prediction") * 2 - 1).cast("int")))


def adaptive_boosting(train: DataFrame, x: str, rounds: int, n_bins: int) -> Callable[[DataFrame], DataFrame]:
    """Discrete AdaBoost: weighted stumps of Spark's library vote; weights of missed rows grow by exp(2 * vote). The weights
    are written down every few rounds. It stops early at a stump that misses nothing, or no less than half."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows, votes = written(_vectors(train, x).select("__x", "__y", F.lit(1.0).alias("w"))), []
    for t in range(rounds):
        stump = DecisionTreeClassifier(labelCol="__y", featuresCol="__x", weightCol="w", maxDepth=1, maxBins=max(2, n_bins), predictionCol="__p").fit(rows)
        told = stump.transform(rows).withColumn("__miss", (F.col("__p") != F.col("__y")).cast("double"))
        miss = told.agg(F.sum(F.col("w") * F.col("__miss")) / F.sum("w")).first()[0]
        if miss >= 0.5:
            break
        vote = 0.5 * math.log((1 - max(miss, 1e-10)) / max(miss, 1e-10))
        votes.append((vote, stump))
        if miss <= 0:
            break
        rows = told.select("__x", "__y", (F.col("w") * F.exp(F.lit(2 * vote) * (F.col("__miss") - miss))).alias("w"))
        if t % 8 == 7:
            rows = written(rows)

    def predict(df: DataFrame) -> DataFrame:
        out = _vectors(df, x).withColumn("__sum", F.lit(0.0))
        for vote, stump in votes:
            out = stump.transform(out).withColumn("__sum", F.col("__sum") + F.lit(vote) * (F.col("__p") * 2 - 1)).drop("rawPrediction", "probability", "__p")
        return _without(out.withColumn("prediction", F.when(F.col("__sum") > 0, 1).otherwise(-1)), "__sum")

    return predict


CLASSIFIERS: dict[str, Classifier] = {"boosted_bins": boosted_bins, "leafwise_trees": leafwise_trees, "boosted_stumps": boosted_stumps, "boosted_trees": boosted_trees, "adaptive_boosting": adaptive_boosting}


def grid_name(spark: SparkSession, kind: str, settings: dict, digits: int = 10) -> str:
    """Names a grid by its settings: kind and hashes of the settings as text."""
    text = F.lit(", ".join(f"{k}={v}" for k, v in sorted(settings.items())))
    return spark.range(1).select(F.concat_ws("_", F.lit(kind), experiment_code(clean_name(text), digits))).first()[0]


def run_grid(spark: SparkSession, data: dict[str, tuple[DataFrame, DataFrame]], label: Column | str, features: str, rounds: list[int], n_bins: list[int], classifiers: dict[str, Classifier] | None = None) -> DataFrame:
    """(data_name, classifier, rounds, n_bins, metric, value, ratio) for each data set (train, test), classifier and
    setting: seconds of fitting, measured for each setting by itself, seconds of prediction, accuracy, sensitivity and
    false alarm rate of train and test, and ratios of each metric to the greatest of the classifiers at that setting."""
    y = F.col(label) if isinstance(label, str) else label
    out = []
    for name, (train, test) in data.items():
        parts = {k: written(df.select(y.cast("int").alias("y"), features)) for k, df in (("train", train), ("test", test))}
        for t, b, (who, fit) in product(rounds, n_bins, (classifiers or {"boosted_bins": boosted_bins}).items()):
            began = time.perf_counter()
            predict = fit(parts["train"], features, t, b)
            found = {"time_fit": time.perf_counter() - began}
            for part, df in parts.items():
                right = (F.col("prediction") == F.col("y")).cast("double")
                began = time.perf_counter()
                r = predict(df).agg(F.avg(right), F.avg(F.when(F.col("y") == 1, right)), F.avg(F.when(F.col("y") == -1, 1 - right))).first()
                found |= {f"time_predict_{part}": time.perf_counter() - began, f"acc_{part}": r[0], f"sensitivity_{part}": r[1], f"far_{part}": r[2]}
            out += [(name, who, t, b, metric, None if v is None else float(v)) for metric, v in found.items()]
    return max_ratios(spark.createDataFrame(out, SCHEMA), ["data_name", "rounds", "n_bins", "metric"])


def staged_grid(spark: SparkSession, data: dict[str, tuple[DataFrame, DataFrame]], label: Column | str, features: str, rounds: list[int], n_bins: list[int]) -> DataFrame:
    """(data_name, n_bins, rounds, part, m, accuracy, sensitivity, far) of the boosted bins: for each data set (train, test)
    and number of bins one fit of the most rounds, whose prefixes are read off in one pass over each part."""
    y, out = F.col(label) if isinstance(label, str) else label, None
    for (name, (train, test)), b in product(data.items(), n_bins):
        parts = {k: written(df.select(y.cast("int").alias("y"), features)) for k, df in (("train", train), ("test", test))}
        model = BoostedBins(rounds=max(rounds), n_bins=b).fit(parts["train"], "y", features)
        for part, df in parts.items():
            rows = model.staged_figures(df, "y", rounds).select(F.lit(name).alias("data_name"), F.lit(b).alias("n_bins"), "rounds", F.lit(part).alias("part"), "m", "accuracy", "sensitivity", "far")
            out = rows if out is None else out.unionByName(rows)
    return out


def random_grid(spark: SparkSession, sizes: list[tuple[int, int, int]], rounds: list[int], n_bins: list[int], classifiers: dict[str, Classifier] | None = None, seed: int = 0) -> DataFrame:
    """run_grid over random data sets of (features, train rows, test rows), named by these."""
    data = {f"{n}-{m}-{k}": (random_matrix(spark, m, n, 62, True, seed), random_matrix(spark, k, n, 62, True, seed + 1)) for n, m, k in sizes}
    return run_grid(spark, data, "y", "x", rounds, n_bins, classifiers)

"""Accuracy figures, ROC and decision thresholds of scored rows (y -1 or 1, score, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradarium.functions.ordering import running_sums, written


def accuracies(scored: DataFrame, by: list[str], y: str = "y", predicted: str = "prediction") -> DataFrame:
    """accuracy, sensitivity (on the positives) and far (false alarm rate on the negatives), in one pass."""
    right = (F.col(y) == F.col(predicted)).cast("double")
    return scored.groupBy(*by).agg(
        F.avg(right).alias("accuracy"),
        F.avg(F.when(F.col(y) == 1, right)).alias("sensitivity"),
        (F.lit(1.0) - F.avg(F.when(F.col(y) == -1, right))).alias("far"),
    )


def class_priors(rows: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, prior)."""
    counts = rows.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(y, "n", (F.col("n") / F.col("__all")).alias("prior"))


def roc_points(scored: DataFrame, y: str = "y", score: str = "score", digits: int = 12) -> DataFrame:
    """(rank, threshold, fp, tp, fpr, tpr): a vertex for each distinct score, highest first, and (0, 0) at rank 0 with an
    infinite threshold. Vertices on a straight line between neighbours are left out, the first and last stay.

    Scores are counted first; ranks and running counts are taken in ranges of the score, neighbours meet by an equi
    join on the rank, so no task sees the whole curve."""
    counts = scored.groupBy(F.round(score, digits).alias("threshold")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("p"), F.count(F.when(F.col(y) == -1, 1)).alias("n"))
    counts = counts.withColumns({"down": -F.col("threshold"), "one": F.lit(1).cast("long")})
    sums = written(running_sums(counts, [], [F.col("down")], {"rank": "one", "tp": "p", "fp": "n"}))
    after = sums.select((F.col("rank") - 1).alias("rank"), F.col("p").alias("next_p"), F.col("n").alias("next_n"))
    bent = sums.join(after, "rank", "left").where("next_p is null or next_p <> p or next_n <> n")
    origin = sums.agg(F.lit(0).cast("long").alias("rank"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("tp"))
    points = origin.unionByName(bent.select("rank", "threshold", "fp", "tp"))
    whole = F.broadcast(sums.agg(F.sum("n").alias("N"), F.sum("p").alias("P")))  # one row
    return points.crossJoin(whole).select("rank", "threshold", "fp", "tp", (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


def precision_threshold(roc: DataFrame, coefficient: float = 0.25) -> DataFrame:
    """One row (rank, precision, threshold). Precision tp / (tp + fp) is taken at vertices with false positives; the
    first best one is mixed with the vertex before it among these, in threshold and precision: c * own + (1 - c) *
    before."""
    own = written(roc.where("fp > 0").withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))))
    best = own.agg(F.min(F.struct((-F.round("precision", 12)).alias("k"), "rank", "precision", "threshold")).alias("s")).select("s.rank", F.col("s.precision").alias("p"), F.col("s.threshold").alias("t"))
    before = own.crossJoin(F.broadcast(best.select(F.col("rank").alias("best")))).where("rank < best").agg(F.max(F.struct("rank", "threshold", "precision")).alias("b"))
    mixed = lambda c, b: F.when(F.col("b").isNull(), F.col(c)).otherwise(F.lit(coefficient) * F.col(c) + F.lit(1 - coefficient) * F.col(f"b.{b}")).alias(b)
    return best.crossJoin(before).select("rank", mixed("p", "precision"), mixed("t", "threshold"))


def max_ratios(measured: DataFrame, by: list[str], value: str = "value", least: float = 1e-9) -> DataFrame:
    """Adds ratio: the greatest value of the group over the row's own; zeros count as `least`."""
    v = F.when(F.col(value) == 0, F.lit(least)).otherwise(F.col(value))
    return measured.withColumn("ratio", F.max(v).over(Window.partitionBy(*by)) / v)

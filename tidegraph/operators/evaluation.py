"""Evaluation of a classifier: confusion matrix, accuracy, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import safe_ratio


def confusion(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """One row per label and one column per predicted label, in label order, empty cells 0."""
    counts = rows.groupBy(F.col(truth).alias("true_label")).agg(
        *[F.count_if(F.col(predicted) == label).alias(label) for label in labels])
    order = rows.sparkSession.createDataFrame([(i, label) for i, label in enumerate(labels)], "position int, true_label string")
    return (F.broadcast(order).join(counts, "true_label", "left").na.fill(0, list(labels))
            .orderBy("position").select("true_label", *labels))


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of right predictions among all rows, also those with other labels."""
    right = F.coalesce((F.col(truth) == F.col(predicted)).cast("double"), F.lit(0.0))
    return rows.agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("total"))


def precision_recall(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """Per label precision, recall and F1 within the label list, 0 where undefined, to four places."""
    known = rows.where(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels))
    sides = known.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.lit(label) for label in labels])
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    per_label = (sides.select("t", "p", "n", F.explode(each).alias("label")).groupBy("label").agg(
        F.sum(F.when((t == F.col("label")) & (p == F.col("label")), n).otherwise(0)).alias("tp"),
        F.sum(F.when((t != F.col("label")) & (p == F.col("label")), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == F.col("label")) & (p != F.col("label")), n).otherwise(0)).alias("fn")))
    ratios = per_label.select("label", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                              safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return ratios.select("label", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
                         F.round(safe_ratio(2 * F.col("precision") * F.col("recall"), both), 4).alias("f1_score"))

"""Evaluation tables of several models from their stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.labels import class_label
from hazardloom.operators.metrics import (
    average_precision,
    confusion_matrix,
    one_vs_rest,
    pr_curve,
    roc_auc,
    roc_curve,
    threshold_counts,
)
from hazardloom.plans.training import N_CLASSES, model_metrics


def evaluation_tables(predictions: DataFrame, k: int = N_CLASSES) -> dict[str, DataFrame]:
    """Confusion, ROC, precision-recall and comparison tables of every ``model``.

    ``predictions`` has (model, y, yhat, scores).
    """
    groups = ["model", "class"]
    counts = threshold_counts(one_vs_rest(predictions, ["model"], "y", "scores", k), groups)
    areas = roc_auc(counts, groups).join(average_precision(counts, groups), groups)
    return {
        "confusion": confusion_matrix(predictions, "y", "yhat", k, ("model",)),
        "roc": roc_curve(counts, groups),
        "pr": pr_curve(counts, groups),
        "areas": areas.withColumn("label", class_label(F.col("class"))),
        "comparison": model_metrics(predictions, k),
    }

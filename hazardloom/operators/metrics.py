"""Classification metrics as aggregates over (y, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.labels import class_label
from hazardloom.functions.numbers import round_exact
from hazardloom.operators.ordered import running_totals


def confusion_matrix(df: DataFrame, y: str, yhat: str, k: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """k x k counts per group, empty cells included.

    Cells are counted before the shuffle; the grid has k * k rows per group.
    """
    counts = df.groupBy(*groups, F.col(y).cast("int").alias("y"), F.col(yhat).cast("int").alias("yhat")).agg(
        F.count("*").alias("n")
    )
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    present = counts.select(*groups).distinct() if groups else counts.agg(F.lit(0).alias("_one"))
    grid = present.select(*groups, F.explode(classes).alias("y")).select(
        *groups, "y", F.explode(classes).alias("yhat")
    )
    return grid.join(counts, [*groups, "y", "yhat"], "left").select(
        *groups, "y", "yhat", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def class_scores(matrix: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class, from a confusion matrix."""
    sides = matrix.select(
        *groups,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ),
        F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    # A diagonal cell appears on both sides, so its hits count double.
    totals = sides.groupBy(*groups, "class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.expr("sum(hit) div 2").alias("hits"),
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    scored = totals.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1_score", f1)


def _means(scores: DataFrame, groups: tuple[str, ...], weighted: bool) -> DataFrame:
    total = F.sum("support")
    names = ["precision", "recall", "f1_score"]

    def mean(c: str) -> Column:
        if weighted:
            return _ratio(F.sum(F.col(c) * F.col("support")), total)
        return F.avg(c)

    return scores.groupBy(*groups).agg(*[mean(c).alias(c) for c in names], total.alias("support"))


def weighted_metrics(scores: DataFrame, groups: tuple[str, ...] = (), digits: int | None = 4) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0 where a ratio has no base."""
    total = F.sum("support")
    accuracy = scores.groupBy(*groups).agg(
        _ratio(F.sum("hits"), total).alias("accuracy"),
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1_score")],
    )
    if digits is None:
        return accuracy
    return accuracy.select(
        *groups,
        *[round_exact(F.col(c), digits).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
    )


def classification_report(scores: DataFrame, groups: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted means."""
    columns = ["precision", "recall", "f1_score", "support"]
    per_class = scores.select(*groups, class_label(F.col("class"), labels).alias("row"), *columns)
    accuracy = scores.groupBy(*groups).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("f1_score"), F.sum("support").alias("support")
    )
    none = F.lit(None).cast("double")
    accuracy = accuracy.select(
        *groups, F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"), "f1_score", "support"
    )
    macro = _means(scores, groups, weighted=False).withColumn("row", F.lit("macro avg"))
    weighted = _means(scores, groups, weighted=True).withColumn("row", F.lit("weighted avg"))
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def one_hot(df: DataFrame, keep: list[str], y: str, k: int) -> DataFrame:
    """Long 0/1 membership rows: one per row and class."""
    return df.select(*keep, y, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class")).select(
        *keep, "class", (F.col(y) == F.col("class")).cast("int").alias("is_class")
    )


def one_vs_rest(df: DataFrame, keep: list[str], y: str, scores: str, k: int) -> DataFrame:
    """Long rows (class, is_class, score) from an array of class scores."""
    per_class = F.posexplode(F.slice(F.col(scores), 1, k)).alias("class", "score")
    return df.select(*keep, y, per_class).select(
        *keep, "class", (F.col(y) == F.col("class")).cast("int").alias("is_class"), "score"
    )


def threshold_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first.

    Needs ``is_class`` (0/1) and ``score``.  Classes without a positive row are left out.
    """
    rows = df.select(
        *groups,
        "score",
        F.col("is_class").cast("long").alias("pos"),
        (1 - F.col("is_class")).cast("long").alias("neg"),
    )
    totals = running_totals(rows, groups, "score", ["pos", "neg"])
    return totals.where(F.col("total_pos") > 0)


def roc_curve(counts: DataFrame, groups: list[str]) -> DataFrame:
    """False and true positive rate per threshold, with the origin (NULL threshold) first.

    A class without negatives has no false positive rate (NULL).
    """
    points = counts.select(
        *groups,
        F.col("score").alias("threshold"),
        F.when(F.col("total_neg") > 0, F.col("cum_neg") / F.col("total_neg")).alias("fpr"),
        (F.col("cum_pos") / F.col("total_pos")).alias("tpr"),
    )
    origin = counts.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def roc_auc(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Area under the ROC curve per group; ties count half.  NULL without negatives.

    Counts are summed as exact decimals, so the order of summation does not matter.
    """
    wins = F.col("neg").cast("decimal(38,0)") * (2 * (F.col("cum_pos") - F.col("pos")) + F.col("pos"))
    summed = counts.groupBy(*groups).agg(
        F.sum(wins.cast("decimal(38,0)")).alias("_wins"),
        F.max("total_pos").alias("n_pos"),
        F.max("total_neg").alias("n_neg"),
    )
    area = F.col("_wins").cast("double") / 2.0 / (F.col("n_pos").cast("double") * F.col("n_neg"))
    return summed.select(*groups, "n_pos", "n_neg", F.when(F.col("n_neg") > 0, area).alias("auc"))


def weighted_auc(aucs: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Support-weighted mean of the class areas; NULL when any class has none."""
    mean = F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")
    return aucs.groupBy(*groups).agg(F.when(F.count_if(F.col("auc").isNull()) == 0, mean).alias("roc_auc"))


def pr_curve(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Precision and recall per threshold, with the end point (NULL threshold, 1, 0)."""
    points = counts.select(
        *groups,
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.col("total_pos")).alias("recall"),
    )
    end = counts.select(*groups).distinct().select(
        *groups,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def average_precision(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Sum of recall steps times precision."""
    step = F.col("pos") / F.col("total_pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return counts.groupBy(*groups).agg(F.sum(step).alias("average_precision"))


def best_per_metric(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """Long rows (model, metric, value, is_best) marking the highest value of each metric."""
    long = df.select(
        model,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])),
    )
    best = long.groupBy("metric").agg(F.max("value").alias("_best"))
    return long.join(best, "metric").select(
        model, "metric", "value", (F.col("value") == F.col("_best")).alias("is_best")
    )


def best_model(df: DataFrame, model: str, f1: str, ord_: str) -> DataFrame:
    """The model with the highest unrounded F1, the first in order on ties."""
    return df.agg(
        F.max_by(F.col(model), F.struct(F.col(f1), -F.col(ord_))).alias("best_model"),
        F.max(f1).alias("best_f1"),
    )

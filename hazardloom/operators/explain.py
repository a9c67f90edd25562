"""Linear attributions: contribution of a feature = weight * (value - mean).

Contributions of a row are one array next to it; ranking inside the row needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.labels import class_label
from hazardloom.functions.numbers import round_exact
from hazardloom.operators.ordered import sample_exact


def contributions(df: DataFrame, features: str, weights: DataFrame, into: str = "contribution") -> DataFrame:
    """Add the contribution array.  ``weights`` has one row (feature, weight, mean) per
    feature number from 0 and is attached as one array value."""
    packed = weights.agg(
        F.array_sort(F.collect_list(F.struct("feature", "weight", "mean")))
    ).scalar()
    value = F.zip_with(
        F.col(features), F.col("_weights"), lambda x, w: w["weight"] * (x.cast("double") - w["mean"])
    )
    return df.withColumn("_weights", packed).withColumn(into, value).drop("_weights")


def row_attribution(df: DataFrame, features: str, names: Column, into: str = "attribution", top: int = 20, keep: int = 10) -> DataFrame:
    """Add the leading risk and protective features of each row.

    The ``top`` features by absolute contribution (lower feature number on ties) are
    split by sign, at most ``keep`` each.
    """
    ranked = F.array_sort(
        F.transform(
            "contribution",
            lambda c, i: F.struct(
                (-F.abs(c)).alias("o"), i.alias("i"), c.alias("c"), F.element_at(F.col(features), i + 1).cast("double").alias("x")
            ),
        )
    )
    entries = F.transform(
        F.slice(ranked, 1, top),
        lambda e: F.struct(
            F.element_at(names, e["i"] + 1).alias("feature"),
            round_exact(e["c"], 4).alias("contribution"),
            round_exact(e["x"], 4).alias("value"),
            (e["c"] > 0).alias("risk"),
        ),
    )

    def side(risk: bool) -> Column:
        chosen = F.filter("_top", lambda e: e["risk"] if risk else ~e["risk"])
        return F.transform(
            F.slice(chosen, 1, keep), lambda e: F.struct(e["feature"], e["contribution"], e["value"])
        )

    return (
        df.withColumn("_top", entries)
        .withColumn(into, F.struct(side(True).alias("risk"), side(False).alias("protective")))
        .drop("_top")
    )


def attribution_text(attribution: Column, cls: Column) -> Column:
    """Sentence from the label and up to three features of either side."""
    # --- fixed values: the sentence parts ---
    def named(side: Column) -> Column:
        return F.array_join(
            F.transform(F.slice(side, 1, 3), lambda e: F.concat(F.lit("**"), e["feature"], F.lit("**"))), ", "
        )

    risk, protective = attribution["risk"], attribution["protective"]
    label = class_label(cls)
    return F.when(
        (F.size(risk) == 0) & (F.size(protective) == 0),
        F.concat(F.lit("Predicted **"), label, F.lit("** — insufficient feature information for explanation.")),
    ).otherwise(
        F.concat(
            F.lit("This molecule is predicted **"),
            label,
            F.lit("**."),
            F.when(
                F.size(risk) > 0, F.concat(F.lit(" Key risk-increasing features: "), named(risk), F.lit("."))
            ).otherwise(""),
            F.when(
                F.size(protective) > 0, F.concat(F.lit(" Protective features: "), named(protective), F.lit("."))
            ).otherwise(""),
        )
    )


def global_importance(df: DataFrame, key: str, sample: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature over all rows, or a reproducible sample of them."""
    chosen = df if sample is None else sample_exact(df, key, sample, unique=True)
    return (
        chosen.select(F.posexplode("contribution").alias("feature", "c"))
        .groupBy("feature")
        .agg(F.avg(F.abs("c")).alias("importance"))
    )


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def dependence_points(df: DataFrame, key: str, features: str, importance: DataFrame, k: int = 5, sample: int | None = None) -> DataFrame:
    """(feature, value, contribution) of all rows, or a sample, for the ``k`` leading features."""
    leading = F.broadcast(top_features(importance, k).select("feature"))  # k rows
    chosen = df if sample is None else sample_exact(df, key, sample, unique=True)
    points = chosen.select(
        key, F.posexplode(F.arrays_zip(F.col(features).alias("x"), F.col("contribution").alias("c"))).alias("feature", "point")
    )
    return points.join(leading, "feature", "left_semi").select(
        key, "feature", F.col("point.x").cast("double").alias("value"), F.col("point.c").alias("contribution")
    )

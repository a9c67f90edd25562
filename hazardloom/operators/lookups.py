"""Rule look-ups as joins, for match rows and rule tables kept as DataFrames.

Which side is broadcast is left to Spark, which knows the sizes in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.text import normalize_key, strip


def alert_diseases(matches: DataFrame, diseases: DataFrame) -> DataFrame:
    """Match rows to the diseases of their alert; unmapped alerts give no rows."""
    table = diseases.select(
        "alert",
        F.col("ord").alias("disease_ord"),
        "disease",
        "base_prob",
        F.col("severity").alias("disease_severity"),
        F.col("description").alias("disease_description"),
    )
    return matches.join(table, "alert")


def alert_organs(matches: DataFrame, organ_scores: DataFrame, organs: DataFrame) -> DataFrame:
    """Match rows to the organs of their alert, tracked organs only."""
    tracked = organ_scores.join(organs.select("organ"), "organ", "left_semi")
    table = tracked.select("alert", F.col("ord").alias("organ_ord"), "organ", F.col("score").alias("organ_score"))
    return matches.join(table, "alert")


def alert_weights(matches: DataFrame, weights: DataFrame, default: float) -> DataFrame:
    """Weight of each match row's alert, the default for an unlisted one."""
    table = weights.select("alert", F.col("weight").alias("_w"))
    joined = matches.join(table, "alert", "left")
    return joined.withColumn("weight", F.coalesce("_w", F.lit(default))).drop("_w")


def name_lookup(df: DataFrame, text: str, names: DataFrame, into: str = "structure") -> DataFrame:
    """Structure of a listed name (any case, trimmed), otherwise the normalised text."""
    table = names.select(F.col("name").alias("_name"), F.col("structure").alias("_structure"))
    key = F.lower(strip(F.col(text)))
    joined = df.withColumn("_key", key).join(table, F.col("_key") == F.col("_name"), "left")
    return joined.withColumn(into, normalize_key(F.coalesce("_structure", F.col(text)))).drop(
        "_key", "_name", "_structure"
    )


def label_lookup(df: DataFrame, cls: str, labels: DataFrame, into: str = "label") -> DataFrame:
    """Label of a class number, ``UNKNOWN`` where the table has none."""
    table = labels.select(F.col("class").alias("_class"), F.col("label").alias("_label"))
    joined = df.join(table, F.col(cls) == F.col("_class"), "left")
    return joined.withColumn(into, F.coalesce("_label", F.lit("UNKNOWN"))).drop("_class", "_label")

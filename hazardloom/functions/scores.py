"""Score functions of single entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardloom.functions.numbers import round_exact

# --- fixed values: class weights of the score, and the score used without a model -----
CLASS_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
NO_MODEL_SCORE = 0.5
NO_MODEL_CLASS = 2


def weighted_class_score(probabilities: Column) -> Column:
    """Class probabilities times the class weights, summed; the default without a model."""
    weights = F.slice(F.array(*[F.lit(w) for w in CLASS_WEIGHTS]), F.lit(1), F.size(probabilities))
    products = F.zip_with(probabilities, weights, lambda p, w: p * w)
    total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    return F.when(probabilities.isNull(), F.lit(NO_MODEL_SCORE)).otherwise(total)


def predicted_class(probabilities: Column) -> Column:
    """Position of the highest probability, the first on ties."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1
    return F.coalesce(best, F.lit(NO_MODEL_CLASS))


def predicted_probability(probabilities: Column) -> Column:
    return F.coalesce(F.array_max(probabilities), F.lit(NO_MODEL_SCORE))


def confidence_score(p: Column, n_alerts: Column, n_available: Column, n_total: Column) -> Column:
    """Certainty, feature coverage and alert agreement, weighted and clipped to [0, 1]."""
    certainty = F.least(F.abs(p - 0.5) * 2.0, F.lit(1.0))
    coverage = F.least(
        n_available.cast("double") / F.greatest(n_total, F.lit(1)).cast("double"), F.lit(1.0)
    )
    agreement = F.when(p > 0.5, F.least(n_alerts.cast("double") * 0.05, F.lit(0.2))).otherwise(F.lit(0.0))
    blended = certainty * 0.5 + coverage * 0.3 + agreement * 0.2
    return round_exact(F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)), 3)


def nonzero_feature_count(features: Column) -> Column:
    """Entries of a feature array that are neither missing nor zero."""
    return F.size(F.filter(features, lambda v: v.isNotNull() & ~F.isnan(v) & (v != 0)))


def danger_level(p: Column, n_alert_rows: Column, lowest: int = 0) -> Column:
    """Danger 0-10 of a single entity; mixtures use ``lowest=1``."""
    return F.least(F.lit(10), F.greatest(F.lit(lowest), (p * 10.0).cast("int") + n_alert_rows.cast("int")))

"""Label and level functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardloom.rules import CLASS_LABELS, constant

# --- fixed values: upper bounds of the probability labels, hit and potency floors of the
# classes, score floors of the levels, severity ranks ---------------------------------
LABEL_BOUNDS = [0.2, 0.4, 0.6, 0.8]
CLASS_FLOORS = [(4, 7, 7.0), (3, 5, 6.0), (2, 3, 5.5), (1, 1, 5.0)]
LEVEL_FLOORS = [("CRITICAL", 70), ("HIGH", 50), ("MODERATE", 25)]
SEVERITY_RANK = {"LOW": 1, "MODERATE": 2, "HIGH": 3, "CRITICAL": 4}


def probability_label(p: Column) -> Column:
    branches = F
    for bound, label in zip(LABEL_BOUNDS, CLASS_LABELS):
        branches = branches.when(p < bound, F.lit(label))
    return branches.when(p.isNotNull(), F.lit(CLASS_LABELS[-1]))


def derive_class(hits: Column, potency: Column) -> Column:
    """Class 0-4 from the hit count or the potency, the highest floor reached winning.

    NULL or NaN on one side leaves the decision to the other.
    """
    number = F.when(~F.isnan(potency), potency)
    branches = F
    for cls, hit_floor, potency_floor in CLASS_FLOORS:
        reached = F.coalesce(hits >= hit_floor, F.lit(False)) | F.coalesce(number >= potency_floor, F.lit(False))
        branches = branches.when(reached, F.lit(cls))
    return branches.otherwise(F.lit(0))


def class_label(cls: Column, labels: list[str] | None = None) -> Column:
    names = constant(labels or CLASS_LABELS, "array<string>")
    return F.coalesce(F.get(names, cls.cast("int")), F.lit("UNKNOWN"))


def score_level(score: Column) -> Column:
    branches = F
    for level, floor in LEVEL_FLOORS:
        branches = branches.when(score >= floor, F.lit(level))
    return branches.otherwise(F.lit("LOW"))


def severity_rank(severity: Column) -> Column:
    ranks = constant(SEVERITY_RANK, "map<string, int>")
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(0))


def severity_of_rank(rank: Column) -> Column:
    return F.get(constant(list(SEVERITY_RANK), "array<string>"), rank - 1)

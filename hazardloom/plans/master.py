"""The labelled master table from assay, measurement and library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.clean import (
    ASSAYS,
    BACKGROUND_POTENCY,
    KEY,
    PROPERTIES,
    TEXT,
    assay_counts,
    clean_measurements,
    fill_constants,
    fill_potency,
    keep_first,
    left_enrich,
    measurement_summary,
    median_impute,
    with_class,
    with_key,
)
from hazardloom.operators.ordered import sample_exact

COUNTS = ["tox_binary", "assay_hits", "assay_tested"]


def clean_base(assays: DataFrame, text: str, order: list[Column], digest: bool = False) -> DataFrame:
    """Assay rows with a usable key, first of each key, with their hit counts."""
    return assay_counts(keep_first(with_key(assays, text, digest=digest), KEY, order))


def clean_library(
    library: DataFrame, text: str, row_id: str, order: list[Column], sample: int | None = None,
    seed: int = 42, digest: bool = False,
) -> DataFrame:
    """Library rows of unique usable key, all of them or a sample of ``sample`` rows.

    For a sample, twice the sample is drawn by row id before the costly key normalisation and
    deduplication, then trimmed to the sample by key.
    """
    drawn = sample_exact(library, row_id, 2 * sample, seed, unique=True) if sample else library
    unique = keep_first(with_key(drawn, text, digest=digest), KEY, order)
    return sample_exact(unique, KEY, sample, seed, unique=True) if sample else unique


def build_master(base: DataFrame, measurements: DataFrame, library: DataFrame) -> DataFrame:
    """Merge cleaned inputs (unique keys), label, then impute, in that order.

    Stacking the library rows that the base lacks and filling base properties from the
    library is one full outer join on the key: a row without base columns is background.
    Every library row appears in it exactly once and the base has no properties of its
    own, so the property medians of the result are those of the library.
    """
    text = [TEXT] if TEXT in base.columns else []
    enriched = fill_potency(
        left_enrich(base.select(KEY, *text, *COUNTS, *[f"`{a}`" for a in ASSAYS]), measurements)
    )
    named = [F.col(t).alias(f"_lib_{t}") for t in text]
    merged = enriched.join(library.select(KEY, *named, *PROPERTIES), KEY, "full_outer")
    for t in text:
        merged = merged.withColumn(t, F.coalesce(t, f"_lib_{t}")).drop(f"_lib_{t}")
    stacked = merged.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in COUNTS},
            "pIC50": F.coalesce("pIC50", F.lit(BACKGROUND_POTENCY)),
        }
    )
    return fill_constants(median_impute(with_class(stacked), PROPERTIES, source=library))


def master_from_sources(
    assays: DataFrame, measurements: DataFrame, library: DataFrame, *,
    assay_text: str = "smiles", assay_order: list[Column], measured_text: str = "Smiles",
    measured_type: str = "Standard Type", measured_value: str = "Standard Value", wanted: str = "IC50",
    library_text: str = "smiles", library_id: str, library_order: list[Column],
    sample: int | None = None, digest: bool = False,
) -> DataFrame:
    """The whole preparation.

    One lazy plan, partitioned on the key throughout.  With ``digest`` the joins compare
    digests, and the normalised text stays beside the key for the feature tables.
    """
    base = clean_base(assays, assay_text, assay_order, digest)
    summary = measurement_summary(
        clean_measurements(measurements, measured_text, measured_type, measured_value, wanted, digest=digest)
    )
    pool = clean_library(library, library_text, library_id, library_order, sample, digest=digest)
    return build_master(base, summary, pool)

"""Cleaning, enrichment and labelling steps of the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.functions.labels import derive_class
from hazardloom.functions.numbers import (
    coerce_numeric,
    hit_ratio_estimate,
    neg_log10_potency,
    row_nonnull_count,
    row_sum,
)
from hazardloom.functions.text import is_usable_key, normalize_key
from hazardloom.operators.ordered import column_medians, grouped_median
from hazardloom.session import computed_once

# --- fixed values: the assay columns, the property columns, the background potency -----
ASSAYS = [
    "NR-AR", "NR-AR-LBD", "NR-AhR", "NR-Aromatase", "NR-ER", "NR-ER-LBD", "NR-PPAR-gamma",
    "SR-ARE", "SR-ATAD5", "SR-HSE", "SR-MMP", "SR-p53",
]
PROPERTIES = ["logP", "qed", "SAS"]
BACKGROUND_POTENCY = 4.0
KEY = "canonical_smiles"
TEXT = "canonical_text"


def with_key(df: DataFrame, text: str, key: str = KEY, digest: bool = False) -> DataFrame:
    """Add the normalised key and drop rows without one.

    With ``digest`` the key is the SHA-256 of the normalised text, so joins and
    deduplication of long texts compare 64 characters; the text stays beside it in
    ``canonical_text``.
    """
    normal = normalize_key(F.col(text))
    usable = df.where(is_usable_key(F.col(text)))
    if not digest:
        return usable.withColumn(key, normal)
    return usable.withColumn(TEXT, normal).withColumn(key, F.sha2(TEXT, 256))


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; ranked before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def assay_counts(df: DataFrame, assays: list[str] = ASSAYS) -> DataFrame:
    """Add hit count, tested count and the binary flag of each row."""
    cells = [F.col(f"`{a}`") for a in assays]
    return (
        df.withColumn("assay_hits", row_sum(cells).cast("int"))
        .withColumn("assay_tested", row_nonnull_count(cells))
        .withColumn("tox_binary", (F.col("assay_hits") > 0).cast("int"))
    )


def clean_measurements(
    df: DataFrame, text: str, kind: str, value: str, wanted: str = "IC50", key: str = KEY, digest: bool = False
) -> DataFrame:
    """Rows of the wanted type with a positive number and a usable key, plus the potency."""
    rows = df.where(F.col(kind) == wanted).withColumn("_value", coerce_numeric(F.col(value).cast("string")))
    rows = with_key(rows.where(F.col("_value") > 0), text, key, digest)
    return rows.select(key, F.col("_value").alias("IC50_nM"), neg_log10_potency(F.col("_value")).alias("pIC50"))


def measurement_summary(df: DataFrame, key: str = KEY) -> DataFrame:
    """Mean potency, exact median raw value and row count per key, safe for hot keys."""
    summary = grouped_median(df, [key], "IC50_nM", "IC50_nM", mean_of="pIC50", count_into="n_measurements")
    return summary.select(key, "pIC50", "IC50_nM", "n_measurements")


def left_enrich(base: DataFrame, measurements: DataFrame, key: str = KEY) -> DataFrame:
    return base.join(measurements.select(key, "pIC50", "IC50_nM"), key, "left")


def fill_potency(df: DataFrame) -> DataFrame:
    """Missing potency from the hit ratio of the row."""
    return df.withColumn("pIC50", F.coalesce("pIC50", hit_ratio_estimate(F.col("assay_hits"))))


def background_rows(library: DataFrame, base: DataFrame, key: str = KEY, assays: list[str] = ASSAYS) -> DataFrame:
    """Library rows whose key the base lacks, with the constants of a non-toxic row."""
    fresh = library.select(key, *PROPERTIES).join(base.select(key), key, "left_anti")
    return fresh.select(
        "*",
        *[F.lit(0).alias(c) for c in ("tox_binary", "assay_hits", "assay_tested")],
        F.lit(BACKGROUND_POTENCY).alias("pIC50"),
        *[F.lit(0.0).alias(a) for a in assays],
    )


def stack(base: DataFrame, background: DataFrame) -> DataFrame:
    """Rows of both; columns missing on one side become NULL."""
    return base.unionByName(background, allowMissingColumns=True)


def lookup_fill(df: DataFrame, library: DataFrame, columns: list[str] = PROPERTIES, key: str = KEY) -> DataFrame:
    """Fill missing properties from the (unique-key) library; creates absent columns."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    side = library.select(key, *[F.col(c).alias(f"_lib_{c}") for c in columns])
    joined = df.join(side, key, "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_lib_{c}")) for c in columns})
    return filled.drop(*[f"_lib_{c}" for c in columns])


def with_class(df: DataFrame) -> DataFrame:
    return df.withColumn("toxicity_class", derive_class(F.col("assay_hits"), F.col("pIC50")))


def median_impute(
    df: DataFrame, columns: list[str] = PROPERTIES, source: DataFrame | None = None
) -> DataFrame:
    """Missing values of each column from the exact median of the whole column.

    ``source`` is another table with the same values in these columns, if one is cheaper to read.
    """
    medians = column_medians(df if source is None else source, columns)
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    attached = computed_once(df.withColumn("_medians", packed), ["_medians"])
    return attached.withColumns(
        {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c))) for c in columns}
    ).drop("_medians")


def fill_constants(df: DataFrame, assays: list[str] = ASSAYS) -> DataFrame:
    filled = {a: F.coalesce(F.col(f"`{a}`"), F.lit(0.0)) for a in assays if a in df.columns}
    if "IC50_nM" in df.columns:
        filled["IC50_nM"] = F.coalesce(F.col("IC50_nM"), F.lit(0.0))
    return df.withColumns(filled)


def class_counts(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n")).orderBy(cls)


def profile(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """Row count, extremes of a value, and rows with and without a flag."""
    return df.agg(
        F.count("*").alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count_if(flag).alias("n_toxic"),
        F.count_if(~flag).alias("n_non_toxic"),
    )


def balanced_class_weights(df: DataFrame, cls: str, into: str = "weight") -> DataFrame:
    """Add n / (k * n_c) per row; rows without a class are dropped.

    The weights, one per class, are one map value of the plan, so a hot class isn't shuffled.
    """
    classed = df.where(F.col(cls).isNotNull())
    counts = classed.groupBy(cls).agg(F.count("*").alias("_nc"))
    everything = Window.partitionBy()  # one row per class
    n, k = F.sum("_nc").over(everything), F.count("*").over(everything)
    weights = counts.select(cls, (n.cast("double") / (k.cast("double") * F.col("_nc"))).alias(into))
    entries = F.map_from_entries(F.collect_list(F.struct(cls, into)))
    attached = classed.withColumn("_weights", weights.agg(entries).scalar())
    return attached.withColumn(into, F.try_element_at("_weights", F.col(cls))).drop("_weights")

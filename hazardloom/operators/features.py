"""Feature tables from texts: counts, hashed n-gram bits and rule presence.

Vectors stay sparse (numbers and values of the set cells) up to the task that trains or scores;
:func:`to_dense` is for others.  Medians and deviations come from the set cells and the
row count, never from all cells.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.numbers import finite_or
from hazardloom.functions.text import COUNT_FEATURES, NGRAM_BITS, count_features, hashed_ngram_bits, normalize_key
from hazardloom.operators.match import match_rules
from hazardloom.operators.ordered import column_medians
from hazardloom.rules import RuleBook
from hazardloom.session import computed_once, write_and_read


def feature_names(rules: RuleBook) -> list[str]:
    """Names of all features in their fixed order."""
    return (
        list(COUNT_FEATURES)
        + [f"ngram_{i}" for i in range(NGRAM_BITS)]
        + [f"rule_{a[0]}" for a in rules.alerts]
    )


def n_features(rules: RuleBook) -> int:
    return len(COUNT_FEATURES) + NGRAM_BITS + len(rules.alerts)


def rule_presence(matches: Column, rules: RuleBook) -> list[Column]:
    """One 0/1 column per rule."""
    present = F.transform(matches, lambda m: m["ord"])
    return [
        F.coalesce(F.array_contains(present, F.lit(a[0])).cast("int"), F.lit(0)).alias(f"rule_{a[0]}")
        for a in rules.alerts
    ]


def sparse_features(df: DataFrame, text: str, rules: RuleBook, keep: list[str]) -> DataFrame:
    """Feature groups per row: ``counts`` (dense), ``bits`` and ``matches`` (sparse).

    Rows without a usable key have NULL groups.
    """
    keyed = df.withColumn("_key", normalize_key(F.col(text)))
    found = F.when(F.col("_key").isNotNull(), match_rules(F.col("_key"), rules))
    grouped = keyed.select(
        *keep,
        F.when(F.col("_key").isNotNull(), F.array(*count_features(F.col("_key")))).alias("counts"),
        hashed_ngram_bits(F.col("_key")).alias("bits"),
        found.alias("matches"),
    )
    return computed_once(grouped, ["counts", "bits", "matches"])


# A feature vector by its set cells: ascending feature numbers from 0 and their values.
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def assemble_vector(rules: RuleBook) -> Column:
    """Sparse vector of the three feature groups in the order of :func:`feature_names`; NULL without counts."""
    n_counts = len(COUNT_FEATURES)
    set_counts = F.filter(F.sequence(F.lit(0), F.lit(n_counts - 1)), lambda i: F.get("counts", i) != 0)
    bits = F.transform("bits", lambda b: b + n_counts)
    present = F.transform("matches", lambda m: (m["ord"] - 1 + n_counts + NGRAM_BITS).cast("int"))
    ones = F.array_repeat(F.lit(1.0), F.size("bits") + F.size("matches"))
    vector = F.struct(
        F.lit(n_features(rules)).alias("size"),
        F.concat(set_counts, bits, present).alias("indices"),
        F.concat(F.filter("counts", lambda v: v != 0), ones).alias("values"),
    )
    return F.when(F.col("counts").isNotNull(), vector).cast(SPARSE)


def is_sparse(df: DataFrame, features: str) -> bool:
    return df.schema[features].dataType.typeName() == "struct"


def set_cells(df: DataFrame, features: str, *keep: str) -> DataFrame:
    """Long form (keep, feature, value) of the cells of a sparse vector; a zero never becomes a row."""
    cells = F.arrays_zip(F.col(f"{features}.indices").alias("feature"), F.col(f"{features}.values").alias("value"))
    return df.select(*keep, F.inline(cells))


def to_dense(features: str) -> Column:
    """All cells of a sparse vector, for consumers that need them; linear in the vector's length."""
    indices, values, size = (F.col(f"{features}.{f}") for f in ("indices", "values", "size"))

    def run(i: Column, k: Column) -> Column:
        # The zeros since the last set cell, and the cell.
        before = F.coalesce(F.get(indices, k - 1), F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0.0), i - before - 1), F.array(F.get(values, k)))

    last = F.coalesce(F.get(indices, F.size(indices) - 1), F.lit(-1))
    return F.concat(F.flatten(F.transform(indices, run)), F.array_repeat(F.lit(0.0), size - 1 - last))


def group_medians(sparse: DataFrame, rules: RuleBook) -> DataFrame:
    """``feature, median`` of the columns whose median isn't 0, over the rows with a usable key.

    Counts are narrowed like any numeric columns; of a 0/1 column the number of set cells says it all.
    """
    usable = sparse.where(F.col("counts").isNotNull())
    names = list(COUNT_FEATURES)
    counts = column_medians(usable.select(*[F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(names)]), names)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column")).cast("int") - 1
    flags = F.concat(F.transform("bits", lambda b: b + len(names)), F.transform("matches", lambda m: (m["ord"] - 1 + len(names) + NGRAM_BITS).cast("int")))
    set_in = usable.select(F.explode(flags).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    rows = usable.agg(F.count(F.lit(1))).scalar()
    often = set_in.withColumn("_rows", rows).where(F.col("n") * 2 >= F.col("_rows"))
    half = often.select("feature", F.when(F.col("n") * 2 == F.col("_rows"), 0.5).otherwise(1.0).alias("median"))
    return counts.select(number.alias("feature"), "median").where("median <> 0").unionByName(half)


def feature_table(
    df: DataFrame, key: str, text: str, rules: RuleBook, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Sparse feature vector per row; rows without a usable key get the column medians.

    Also marks such rows in ``imputed``.  The feature groups are written once, as both the medians and the
    vectors come from them.
    """
    sparse = write_and_read(sparse_features(df, text, rules, [key, *keep]), "features")
    entries = F.sort_array(F.collect_list(F.struct("feature", "median")))
    medians = group_medians(sparse, rules).agg(entries.alias("m")).select(
        F.struct(
            F.lit(n_features(rules)).alias("size"),
            F.transform("m", lambda e: e["feature"]).alias("indices"),
            F.transform("m", lambda e: e["median"]).alias("values"),
        ).cast(SPARSE)
    )
    vectors = sparse.withColumn("features", F.coalesce(assemble_vector(rules), medians.scalar()))
    return computed_once(vectors.select(key, *keep, F.col("counts").isNull().alias("imputed"), "features"), ["features"])


def matrix_median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-finite cells become the exact column median, or 0 if a column has no value.

    Also adds ``all_missing`` for rows without any finite cell.
    """
    clean = df.withColumns({c: finite_or(F.col(c).cast("double"), None) for c in columns})
    medians = column_medians(clean, columns)
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.col(c).isNull()
    return (
        computed_once(clean.withColumn("all_missing", missing).withColumn("_medians", packed), ["_medians"])
        .withColumns(
            {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c)), F.lit(0.0)) for c in columns}
        )
        .drop("_medians")
    )


def scaler_stats(df: DataFrame, features: str) -> DataFrame:
    """One row with the arrays of means and population deviations of a feature array or sparse vector.

    The summarizer keeps one state of the vector's length per task.  Of a sparse vector only the set
    cells are summed; the zeros enter by their number.
    """
    if is_sparse(df, features):
        return _sparse_stats(df, features)
    vector = array_to_vector(F.col(features).cast("array<double>"))
    stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s"))
    share = (F.col("s.count") - 1) / F.col("s.count")
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"), lambda v: F.sqrt(F.when(F.col("s.count") > 1, v * share).otherwise(0.0))
        ).alias("std"),
    )


def _sparse_stats(df: DataFrame, features: str) -> DataFrame:
    cells = set_cells(df, features).groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.avg("value").alias("own"), F.var_pop("value").alias("var")
    )
    size = df.agg(F.count(F.col(features)).alias("n"), F.max(f"{features}.size").alias("size"))
    # Two groups, the set cells and the zeros, put together.
    k, n, own = F.col("k"), F.col("_n.n"), F.col("own")
    spread = F.sqrt((F.col("var") * k + own * own * k * (n - k) / n) / n)
    packed = cells.withColumn("_n", size.select(F.struct("n", "size")).scalar()).select("feature", (own * k / n).alias("mean"), spread.alias("std"))
    by_feature = packed.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("m"))
    whole = by_feature.withColumn("_size", size.select("size").scalar())
    each = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.try_element_at("m", i))
    listed = whole.select(F.when(F.col("_size") > 0, each).otherwise(F.array().cast("array<struct<mean:double,std:double>>")).alias("e"))
    return listed.select(
        F.transform("e", lambda x: F.coalesce(x["mean"], F.lit(0.0))).alias("mean"),
        F.transform("e", lambda x: F.coalesce(x["std"], F.lit(0.0))).alias("std"),
    )


def standard_scale(df: DataFrame, features: str, into: str = "scaled") -> DataFrame:
    """(x - mean) / std per feature with the population deviation; a zero deviation divides by 1."""
    stats = scaler_stats(df, features)
    return apply_scaler(df, features, stats, into)


def apply_scaler(df: DataFrame, features: str, stats: DataFrame, into: str = "scaled") -> DataFrame:
    packed = stats.select(F.arrays_zip("mean", "std").alias("stats")).scalar()
    scaled = F.zip_with(
        F.col(features),
        F.col("_stats"),
        lambda x, s: (x.cast("double") - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"]),
    )
    return df.withColumn("_stats", packed).withColumn(into, scaled).drop("_stats")

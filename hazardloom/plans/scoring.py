"""Scoring single entities, mixtures and mixed batches, set-at-a-time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.labels import probability_label
from hazardloom.functions.numbers import potency_from_probability, round_exact
from hazardloom.functions.scores import (
    NO_MODEL_SCORE,
    confidence_score,
    danger_level,
    predicted_class,
    predicted_probability,
    weighted_class_score,
)
from hazardloom.functions.text import (
    is_usable_key,
    n_ngram_bits,
    n_present_counts,
    normalize_key,
    split_lines,
    split_parts,
)
from hazardloom.operators.features import n_features
from hazardloom.operators.health import disease_names, with_health
from hazardloom.operators.match import (
    alert_report,
    boosted_probability,
    compact,
    discounted_boost,
    match_rules,
    override_floor,
)
from hazardloom.operators.mixture import (
    MAX_COMPONENTS,
    MIN_COMPONENTS,
    collect_components,
    score_components,
    truncate_components,
)
from hazardloom.rules import RuleBook
from hazardloom.session import computed_once


def available_features(key: Column, matches: Column) -> Column:
    """Number of non-zero features of a text without building the dense vector."""
    return n_present_counts(key) + n_ngram_bits(key) + F.size(matches)


def with_boosted(df: DataFrame, text: str, base: Column, rules: RuleBook) -> DataFrame:
    """Matches, override floor and boosted probability of every usable text.

    Adds ``key``, ``matches``, ``base``, ``override`` and ``p``; rows without a usable key
    are dropped.  Map-only.
    """
    keyed = df.where(is_usable_key(F.col(text))).withColumn("key", normalize_key(F.col(text)))
    matched = computed_once(keyed.withColumn("matches", match_rules(F.col("key"), rules)), ["key", "matches"])
    floored = (
        matched.withColumn("base", base)
        .withColumn("override", override_floor(F.col("matches")))
        .withColumn("boost", discounted_boost(F.col("matches")))
    )
    boosted = floored.withColumn("p", boosted_probability(F.col("base"), F.col("boost"), F.col("override")))
    return computed_once(boosted.drop("boost"), ["base", "override", "p"])


def score_entities(
    df: DataFrame,
    text: str,
    rules: RuleBook,
    probabilities: Column | None = None,
    base: Column | None = None,
    health: bool = True,
) -> DataFrame:
    """Score every usable text of a table; all result columns are added to the row.

    ``probabilities`` is a class probability array; ``base`` is a ready score instead.
    With neither, the score without a model is used.
    """
    no_model = F.lit(None).cast("array<double>")
    classes = probabilities if probabilities is not None else no_model
    score = base if base is not None else weighted_class_score(classes)
    raw = predicted_probability(classes) if base is None else base
    boosted = with_boosted(df, text, score, rules)
    scored = (
        boosted.withColumn("report", alert_report(F.col("matches"), rules))
        .withColumn("n_available", available_features(F.col("key"), F.col("matches")))
        .withColumn("probability", round_exact(F.col("p"), 4))
        .withColumn("raw_probability", round_exact(raw, 4))
        .withColumn("predicted_class", predicted_class(classes))
        .withColumn("label", probability_label(F.col("p")))
        .withColumn(
            "confidence",
            confidence_score(F.col("p"), F.size("matches"), F.col("n_available"), F.lit(n_features(rules))),
        )
        .withColumn("potency_estimate", potency_from_probability(F.col("p")))
        .withColumn("size_estimate", F.length("key").cast("double"))
    )
    return with_health(scored, rules) if health else scored


def report_rows(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Flat report of scored entities, one row each."""
    return scored.select(
        *keep,
        F.col("key").alias("SMILES"),
        F.col("label").alias("Toxicity Label"),
        F.col("probability").alias("Toxicity Probability"),
        F.col("confidence").alias("Confidence"),
        F.col("potency_estimate").alias("pIC50 Estimate"),
        F.col("size_estimate").alias("Text Length"),
        F.size("matches").alias("Structural Alerts"),
        F.col("report.explanation").alias("Explanation"),
        disease_names(F.col("diseases")).alias("Diseases"),
    )


def score_mixture_rows(
    df: DataFrame, mixture: str, order: list[Column], text: str, base: Column, rules: RuleBook,
    match_table: DataFrame | None = None, match_key: str | None = None, health: bool = True,
) -> DataFrame:
    """Score mixtures given as one row per component.

    Components that refer to a dimension (``match_table`` with ``match_key``, see
    :func:`match_dimension`) reuse what was computed once per dimension row; otherwise
    the text of each row is matched.
    The only shuffle is on the mixture key, besides a large dimension's join.
    """
    if match_table is None:
        # Matching is row work: numbers go through the shuffle, not texts.
        rows = truncate_components(match_dimension(df, text, rules).drop(text), mixture, order)
    else:
        rows = truncate_components(df, mixture, order).join(match_table, match_key, "left")
    rows = rows.withColumn("p", boosted_probability(base, F.col("boost"), F.col("override")))
    fields = [
        F.col("key").alias("key"),
        probability_label(F.col("p")).alias("label"),
        round_exact(F.col("p"), 4).alias("probability"),
        confidence_score(F.col("p"), F.size("matches"), F.col("n_available"), F.lit(n_features(rules))).alias(
            "confidence"
        ),
        F.col("matches").alias("matches"),
    ]
    mixtures = collect_components(rows, mixture, F.col("key").isNotNull(), fields)
    return score_components(mixtures, rules, health)


def match_dimension(df: DataFrame, text: str, rules: RuleBook) -> DataFrame:
    """Add what a component needs of its text (NULL ``key`` for an unusable text).

    That is ``key``, ``matches`` (numbers and counts), ``override``, ``boost`` and
    ``n_available``; none of it depends on the component's base probability.
    """
    keyed = df.withColumn("key", normalize_key(F.col(text)))
    matched = keyed.withColumn("_found", match_rules(F.col("key"), rules))
    found = F.col("_found")
    counted = (
        matched.withColumn("n_available", available_features(F.col("key"), found))
        .withColumn("override", override_floor(found))
        .withColumn("boost", discounted_boost(found))
        .withColumn("matches", compact(found))
        .drop("_found")
    )
    return computed_once(counted, ["key", "matches", "n_available", "override", "boost"])


def score_part_arrays(
    df: DataFrame, parts: str, rules: RuleBook, base: Callable[[Column], Column] | None = None,
    bases: str | None = None,
) -> DataFrame:
    """Turn an array of component texts into scored ``components``, within the row.

    ``base`` gives the base score of a text, or ``bases`` names an array with the base score
    of every component; with neither, the score without a model is used.
    """

    def score(key: Column, i: Column) -> Column:
        if bases is not None:
            return F.get(F.col(bases), i)
        return base(key) if base is not None else F.lit(NO_MODEL_SCORE)

    stage_1 = F.transform(
        parts,
        lambda key, i: F.struct(
            (i + 1).alias("pos"), key.alias("key"), score(key, i).alias("base"), match_rules(key, rules).alias("matches")
        ),
    )
    stage_2 = F.transform(
        "_s1",
        lambda c: F.struct(
            c["pos"], c["key"], c["base"], c["matches"],
            override_floor(c["matches"]).alias("override"),
            discounted_boost(c["matches"]).alias("boost"),
            available_features(c["key"], c["matches"]).alias("available"),
        ),
    )
    stage_3 = F.transform(
        "_s2",
        lambda c: F.struct(
            c["pos"], c["key"], compact(c["matches"]).alias("matches"), c["available"],
            boosted_probability(c["base"], c["boost"], c["override"]).alias("p"),
        ),
    )
    components = F.transform(
        "_s3",
        lambda c: F.struct(
            c["pos"].alias("pos"),
            c["key"].alias("key"),
            probability_label(c["p"]).alias("label"),
            round_exact(c["p"], 4).alias("probability"),
            confidence_score(c["p"], F.size(c["matches"]), c["available"], F.lit(n_features(rules))).alias(
                "confidence"
            ),
            c["matches"].alias("matches"),
        ),
    )
    staged = df.withColumn("_s1", stage_1).withColumn("_s2", stage_2).withColumn("_s3", stage_3)
    return computed_once(
        staged.withColumn("components", components).drop("_s1", "_s2", "_s3"), ["components"]
    )


# Adds an array of base scores, under the second name, beside an array of component texts.
AddBases = Callable[[DataFrame, str, str], DataFrame]


def score_mixture_texts(
    df: DataFrame, text: str, rules: RuleBook, base: Callable[[Column], Column] | None = None,
    add_bases: AddBases | None = None, max_components: int = MAX_COMPONENTS,
) -> DataFrame:
    """Score free mixture texts (lines pooled); texts with fewer than two components give no row."""
    listed = df.withColumn("_parts", split_lines(F.col(text), rules.names))
    return score_mixture_lists(listed, "_parts", rules, base, add_bases, max_components).drop("_parts")


def score_mixture_lists(
    df: DataFrame, parts: str, rules: RuleBook, base: Callable[[Column], Column] | None = None,
    add_bases: AddBases | None = None, max_components: int = MAX_COMPONENTS,
) -> DataFrame:
    """Score mixtures given as an array of component texts.

    The first ``max_components`` count; unusable ones among them drop out, and fewer than two
    usable ones give no row.  ``n_given`` and ``n_used`` tell how many there were and count.
    """
    first = F.transform(F.slice(F.col(parts), 1, max_components), normalize_key)
    listed = df.withColumn("n_given", F.size(parts)).withColumn("_usable", F.array_compact(first))
    mixtures = listed.where(F.size("_usable") >= MIN_COMPONENTS).withColumn("n_used", F.size("_usable"))
    bases = None
    if add_bases is not None:
        bases = "_bases"
        mixtures = add_bases(mixtures, "_usable", bases)
    scored = score_part_arrays(mixtures, "_usable", rules, base, bases).drop("_usable", "_bases")
    return score_components(scored, rules)


def mixture_report(scored: DataFrame, mixture: str) -> DataFrame:
    """Component rows of every mixture followed by its combined row (``line`` gives the order)."""
    parts = scored.select(mixture, F.inline("components")).select(
        mixture,
        F.col("pos").alias("line"),
        F.col("key").alias("SMILES"),
        F.col("label").alias("Label"),
        F.col("probability").alias("Probability"),
        F.col("confidence").alias("Confidence"),
        F.size("matches").cast("string").alias("Alerts"),
    )
    total = scored.select(
        mixture,
        F.lit(MAX_COMPONENTS + 1).alias("line"),
        F.lit("=== COMBINED ===").alias("SMILES"),
        F.col("label").alias("Label"),
        F.col("final_probability").alias("Probability"),
        F.col("combined_confidence").alias("Confidence"),
        F.col("interaction.type").alias("Alerts"),
    )
    return parts.unionByName(total)


def detect_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The single and the mixture column of an upload; lower case wins, one must exist."""
    single = next((c for c in ("smiles", "SMILES") if c in columns), None)
    mixture = next((c for c in ("mixture", "Mixture") if c in columns), None)
    if single is None and mixture is None:
        raise ValueError("the table must have a smiles or mixture column")
    return single, mixture


def batch_route(
    df: DataFrame, rules: RuleBook, keep: list[str], base: Callable[[Column], Column] | None = None,
    add_bases: AddBases | None = None, max_components: int = MAX_COMPONENTS,
) -> DataFrame:
    """Score an upload table row by row: mixture, else single, else error.

    A mixture text with fewer than two components falls through to the single column.
    Every row chooses its component list first and is then scored once, in one map stage.
    Of a mixture the first ``max_components`` count; ``N_Given`` tells how many there were.
    """
    single, mixture = detect_columns(df.columns)
    null = F.lit(None).cast("string")
    single_col = F.col(single).cast("string") if single else null
    mixture_col = F.col(mixture).cast("string") if mixture else null
    listed = (
        df.withColumn("_given", split_parts(mixture_col, rules.names))
        .withColumn("_mix", F.slice("_given", 1, max_components))
        .withColumn("_one", F.slice(split_parts(single_col, rules.names), 1, 1))
    )
    routed = listed.withColumn(
        "Mode",
        F.when(F.size("_mix") >= MIN_COMPONENTS, "Mixture").when(F.size("_one") >= 1, "Single").otherwise("Error"),
    ).withColumn(
        "_parts",
        F.when(F.col("Mode") == "Mixture", F.col("_mix")).otherwise(F.col("_one")),
    )
    bases = None
    if add_bases is not None:
        bases = "_bases"
        routed = add_bases(routed, "_parts", bases)
    scored = score_components(score_part_arrays(routed, "_parts", rules, base, bases), rules)
    first = F.get("components", F.lit(0))
    is_mixture, is_single = F.col("Mode") == "Mixture", F.col("Mode") == "Single"

    def pick(for_mixture: Column, for_single: Column, for_error: Column) -> Column:
        return F.when(is_mixture, for_mixture).when(is_single, for_single).otherwise(for_error)

    return scored.select(
        *keep,
        pick(mixture_col, single_col, single_col if single else mixture_col).alias("Input"),
        "Mode",
        pick(F.col("label"), first["label"], F.lit("UNKNOWN")).alias("Label"),
        pick(F.col("final_probability"), first["probability"], F.lit(0.0)).alias("Probability"),
        pick(F.col("combined_confidence"), first["confidence"], F.lit(0.0)).alias("Confidence"),
        pick(F.col("interaction.type"), F.lit("N/A"), F.lit("N/A")).alias("Interaction"),
        pick(F.size("components"), F.lit(1), F.lit(0)).alias("N_Components"),
        pick(F.size("_given"), F.lit(1), F.lit(0)).alias("N_Given"),
        pick(
            F.col("danger_level"), danger_level(first["probability"], F.size("all_matches")), F.lit(0)
        ).alias("Danger_Level"),
        pick(disease_names(F.col("diseases")), disease_names(F.col("diseases")), F.lit("")).alias("Diseases"),
        pick(F.col("most_dangerous"), F.lit(""), F.lit("")).alias("Most_Dangerous"),
    )


def batch_summary(batch: DataFrame) -> DataFrame:
    """Totals over a batch; error rows count with zeros."""
    return batch.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("Label").isin("TOXIC", "HIGH RISK", "CRITICAL")).alias("toxic_plus"),
        F.avg("Probability").alias("avg_probability"),
        F.max("Danger_Level").alias("max_danger"),
    )


def label_distribution(batch: DataFrame, label: str = "Label") -> DataFrame:
    return batch.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label)


def top_terms(df: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The most frequent trimmed entries of comma lists; ties by name."""
    terms = df.select(F.explode(F.split(text, ",")).alias("term")).select(F.trim("term").alias("term"))
    counted = terms.where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "term").limit(k)

"""Mixtures: grouping components, pair rules, combination and bounded escalation.

A mixture is one row with an array of at most ten components
``(pos, key, label, probability, confidence, matches)``, the matches being rule numbers
with counts.  The ten come first, so no later step meets an unbounded group, and all steps
after the grouping are row expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.functions.labels import probability_label
from hazardloom.functions.numbers import round_exact, round_exact_once
from hazardloom.functions.scores import danger_level
from hazardloom.operators.health import with_health
from hazardloom.session import computed_if_read
from hazardloom.rules import (
    CONTRAST_INTERACTION,
    MANY_ALERTS_INTERACTION,
    MODERATE_INTERACTION,
    NO_INTERACTION,
    RuleBook,
    constant,
)

RESULT_COLUMNS = [
    "probabilities", "all_matches", "rule_sets", "best_rule", "interaction", "combined", "stats", "escalated",
    "escalation_text", "final_probability", "explanation", "label", "combined_confidence", "most_dangerous",
    "danger_level",
]
MAX_COMPONENTS = 10
MIN_COMPONENTS = 2

# --- fixed values: when components contrast or are moderate, and the bounds of the escalation ---
CONTRAST_LOW, CONTRAST_HIGH = 0.2, 0.6
MODERATE_LOW, MODERATE_HIGH = 0.3, 0.6
MODERATE_MODIFIER, MANY_ALERTS, MANY_ALERTS_MODIFIER = 1.1, 5, 1.2
ESCALATION_RISE, ESCALATION_CAP = 0.15, 0.95
WEIGHT_SHARE, WEIGHT_RISE = 0.5, 0.25
CO_BOOST_EACH, CO_BOOST_MOST = 0.03, 0.10
MULTI_BOOST_TWO, MULTI_BOOST_MORE = 0.06, 0.10


def truncate_components(df: DataFrame, mixture: str, order: list[Column], pos: str = "pos") -> DataFrame:
    """Number the components of each mixture and keep the first ten.

    The rank filter is applied before the shuffle too (a partial top-ten per map task),
    so a mixture holding a large share of the rows sends at most ten rows per task.
    """
    w = Window.partitionBy(mixture).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).where(F.col(pos) <= MAX_COMPONENTS)


def collect_components(df: DataFrame, mixture: str, usable: Column, fields: list[Column]) -> DataFrame:
    """One row per mixture with its usable components in order.

    Expects rows numbered by :func:`truncate_components`; mixtures with fewer than two
    inputs or fewer than two usable components give no row.
    """
    packed = F.when(usable, F.struct(F.col("pos").alias("pos"), *fields))
    grouped = df.groupBy(mixture).agg(F.sort_array(F.collect_list(packed)).alias("components"))
    return grouped.where(F.size("components") >= MIN_COMPONENTS)


def component_pairs(components: Column) -> Column:
    """All pairs i < j of one mixture (at most 45, since a mixture has at most ten components)."""
    return F.flatten(
        F.transform(
            components,
            lambda a: F.transform(
                F.filter(components, lambda b: b["pos"] > a["pos"]),
                lambda b: F.struct(
                    a["pos"].alias("pos_a"),
                    b["pos"].alias("pos_b"),
                    a["key"].alias("key_a"),
                    b["key"].alias("key_b"),
                ),
            ),
        )
    )


def rule_sets(components: Column) -> Column:
    """Set of rule numbers per component."""
    return F.transform(components, lambda c: F.transform(c["matches"], lambda m: m["ord"]))


def alert_sets(sets: Column, rules: RuleBook) -> Column:
    """Sorted set of alert names per component."""
    names = constant([a[1] for a in rules.alerts], "array<string>")
    return F.transform(sets, lambda s: F.array_sort(F.transform(s, lambda o: F.get(names, o - 1))))


def _rule_fires(sets: Column, rule: tuple, rules: RuleBook) -> Column:
    """Alert a in one component and alert b in another one, either way round.

    That holds exactly when both occur and the components holding either number two or
    more, so no pair of components has to be formed.
    """
    number = {alert[1]: alert[0] for alert in rules.alerts}
    if rule[2] not in number or rule[3] not in number:
        return F.lit(False)
    a, b = F.lit(number[rule[2]]), F.lit(number[rule[3]])
    holders = F.filter(sets, lambda s: F.array_contains(s, a) | F.array_contains(s, b))
    return (
        F.exists(sets, lambda s: F.array_contains(s, a))
        & F.exists(sets, lambda s: F.array_contains(s, b))
        & (F.size(holders) >= 2)
    )


def _rule_struct(rule: tuple) -> Column:
    ord_, name, _, _, modifier, explanation = rule
    return F.struct(
        F.lit(ord_).alias("ord"),
        F.lit(name).alias("rule"),
        F.lit(modifier).alias("modifier"),
        F.lit(explanation).alias("explanation"),
    )


def fired_rules(sets: Column, rules: RuleBook) -> Column:
    """All fired pair rules in rule order."""
    return F.array_compact(
        F.array(*[F.when(_rule_fires(sets, r, rules), _rule_struct(r)) for r in rules.pair_rules])
    )


def best_rule(sets: Column, rules: RuleBook) -> Column:
    """The fired rule with the highest modifier above 1, the first on ties; NULL if none."""
    ranked = sorted((r for r in rules.pair_rules if r[4] > 1.0), key=lambda r: (-r[4], r[0]))
    return F.coalesce(*[F.when(_rule_fires(sets, r, rules), _rule_struct(r)) for r in ranked])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    """Mean of up to ten values.

    The result is rounded to few digits and often sits on a tie, so the order of addition
    is fixed: eight or more values add the first eight in pairs, as vectorised sums do.
    """
    v = [F.get(values, F.lit(i)) for i in range(8)]
    first_eight = ((v[0] + v[1]) + (v[2] + v[3])) + ((v[4] + v[5]) + (v[6] + v[7]))
    rest = F.slice(values, F.lit(9), F.greatest(F.size(values) - 8, F.lit(0)))
    paired = F.aggregate(rest, first_eight, lambda a, x: a + x)
    total = F.when(F.size(values) >= 8, paired).otherwise(_sum(values))
    return total / F.nullif(F.size(values), F.lit(0))


def interaction(best: Column, probabilities: Column, n_alert_rows: Column) -> Column:
    """Interaction type, modifier and explanation.  Without a fired rule: contrasting
    probabilities, then several moderate ones, then many alerts."""
    contrast = (F.array_min(probabilities) < CONTRAST_LOW) & (F.array_max(probabilities) > CONTRAST_HIGH)
    moderate = F.size(F.filter(probabilities, lambda p: (p > MODERATE_LOW) & (p < MODERATE_HIGH))) >= 2

    def result(kind: str, modifier: Column, explanation: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), modifier.alias("modifier"), explanation.alias("explanation"))

    return (
        F.when(best.isNotNull(), result("SYNERGISTIC", best["modifier"], best["explanation"]))
        .when(contrast, result("ADDITIVE", F.lit(1.0), F.lit(CONTRAST_INTERACTION)))
        .when(moderate, result("ADDITIVE", F.lit(MODERATE_MODIFIER), F.lit(MODERATE_INTERACTION)))
        .when(n_alert_rows >= MANY_ALERTS, result("SYNERGISTIC", F.lit(MANY_ALERTS_MODIFIER), F.lit(MANY_ALERTS_INTERACTION)))
        .otherwise(result("INDEPENDENT", F.lit(1.0), F.lit(NO_INTERACTION)))
    )


def combine_probabilities(kind: Column, modifier: Column, probabilities: Column) -> Column:
    """Combined probability of a mixture for its interaction type."""
    none_acts = F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * (F.lit(1.0) - p))
    combined = (
        F.when(kind == "SYNERGISTIC", (F.lit(1.0) - none_acts) * modifier)
        .when(kind == "ANTAGONISTIC", _mean(probabilities) * 0.8)
        .when(kind == "ADDITIVE", _mean(probabilities) * modifier)
        .otherwise(F.array_max(probabilities))
    )
    return F.least(round_exact_once(combined, 4), F.lit(0.999))


def alert_stats(components: Column, all_matches: Column, rules: RuleBook) -> Column:
    """Weight sum, distinct alerts and toxic count of a mixture.

    A component counts once for two or more alerts and once more for a probability of
    at least .35.
    """
    toxic = F.aggregate(
        components,
        F.lit(0),
        lambda a, c: a
        + (F.size(c["matches"]) >= 2).cast("int")
        + (c["probability"] >= 0.35).cast("int"),
    )
    return F.struct(
        _sum(F.transform(all_matches, lambda m: rules.weight_of(m["ord"]))).alias("weight"),
        F.size(F.array_distinct(F.transform(all_matches, lambda m: m["ord"]))).alias("distinct_alerts"),
        toxic.alias("toxic_count"),
    )


def with_escalation(df: DataFrame, stats: str = "stats", probabilities: str = "probabilities") -> DataFrame:
    """Add ``escalated`` and ``escalation_text``: a bounded rise above the most probable component."""
    weight, distinct = F.col(stats)["weight"], F.col(stats)["distinct_alerts"]
    toxic = F.col(stats)["toxic_count"]
    normalized = weight / F.greatest(F.size(probabilities), F.lit(1))
    highest, cap, base = F.col("_max"), F.col("_cap"), F.col("_base")
    co_boost = F.when(
        distinct >= 2, (cap - base) * F.least(F.lit(CO_BOOST_MOST), F.lit(CO_BOOST_EACH) * distinct)
    ).otherwise(F.lit(0.0))
    multi_boost = F.when(
        toxic >= 2, (cap - F.col("_co")) * F.when(toxic == 2, MULTI_BOOST_TWO).otherwise(MULTI_BOOST_MORE)
    ).otherwise(F.lit(0.0))

    def part(name: str, value: Column) -> Column:
        return F.when(value > 0, F.format_string(f"; {name}=%.3f", round_exact(value, 3))).otherwise("")

    text = F.concat(
        F.format_string(
            "total_alert_score=%.2f, normalized=%.3f", round_exact(weight, 2), round_exact(F.col("_norm"), 3)
        ),
        part("co_occurrence_boost", F.col("_co_boost")),
        part("multi_toxic_boost", F.col("_multi_boost")),
    )
    raised = (
        df.withColumn("_max", F.array_max(probabilities))
        .withColumn("_norm", normalized)
        .withColumn("_cap", F.least(highest + ESCALATION_RISE, F.lit(ESCALATION_CAP)))
        .withColumn(
            "_base",
            F.least(highest * (F.lit(1.0) + F.least(F.col("_norm") * WEIGHT_SHARE, F.lit(WEIGHT_RISE))), cap),
        )
        .withColumn("_co_boost", co_boost)
        .withColumn("_co", F.least(base + F.col("_co_boost"), cap))
        .withColumn("_multi_boost", multi_boost)
        .withColumn("_esc", F.least(F.col("_co") + F.col("_multi_boost"), cap))
    )
    active = weight > 0
    return (
        raised.withColumn("escalated", F.when(active, round_exact(F.col("_esc"), 4)).otherwise(F.lit(0.0)))
        .withColumn("escalation_text", F.when(active, text).otherwise(F.lit("")))
        .drop("_max", "_norm", "_cap", "_base", "_co_boost", "_co", "_multi_boost", "_esc")
    )


def with_override(df: DataFrame) -> DataFrame:
    """Final probability: the escalated one where it is larger, its text then appended."""
    larger = F.col("escalated") > F.col("combined")
    return df.withColumn("final_probability", F.greatest("combined", "escalated")).withColumn(
        "explanation",
        F.when(
            larger & (F.col("escalation_text") != ""),
            F.concat(F.col("interaction.explanation"), F.lit(" "), F.col("escalation_text")),
        ).otherwise(F.col("interaction.explanation")),
    )


def most_dangerous(components: Column) -> Column:
    """Component with the highest probability, the first on ties."""
    ranked = F.transform(
        components, lambda c: F.struct(c["probability"].alias("p"), (-c["pos"]).alias("o"), c["key"].alias("key"))
    )
    return F.array_max(ranked)["key"]


def mixture_confidence(confidences: Column) -> Column:
    return round_exact_once(_mean(confidences) * 0.9, 3)


def score_components(df: DataFrame, rules: RuleBook, health: bool = True) -> DataFrame:
    """Score mixtures held as ``components`` arrays; adds all mixture results as columns."""
    c = F.col("components")
    staged = (
        df.withColumn("probabilities", F.transform(c, lambda x: x["probability"]))
        .withColumn("_confidences", F.transform(c, lambda x: x["confidence"]))
        .withColumn("all_matches", F.flatten(F.transform(c, lambda x: x["matches"])))
        .withColumn("rule_sets", rule_sets(c))
        .withColumn("best_rule", best_rule(F.col("rule_sets"), rules))
        .withColumn(
            "interaction", interaction(F.col("best_rule"), F.col("probabilities"), F.size("all_matches"))
        )
        .withColumn(
            "combined",
            combine_probabilities(
                F.col("interaction.type"), F.col("interaction.modifier"), F.col("probabilities")
            ),
        )
        .withColumn("stats", alert_stats(c, F.col("all_matches"), rules))
    )
    final = with_override(with_escalation(staged))
    final = (
        final.withColumn("label", probability_label(F.col("final_probability")))
        .withColumn("combined_confidence", mixture_confidence(F.col("_confidences")))
        .withColumn("most_dangerous", most_dangerous(c))
        .withColumn("danger_level", danger_level(F.col("final_probability"), F.size("all_matches"), lowest=1))
    )
    final = computed_if_read(final.drop("_confidences"), RESULT_COLUMNS)
    return with_health(final, rules, "all_matches") if health else final

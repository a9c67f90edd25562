"""Disease and organ risk from the matches of an entity or a mixture.

The match array is expanded through constant rule maps and folded in match order
(the disease fold rounds at every step, so its order matters).  Everything stays in
the row: no shuffle, and the arrays are bounded by the rule tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.labels import SEVERITY_RANK, score_level, severity_of_rank
from hazardloom.functions.numbers import round_exact_once
from hazardloom.operators.match import percent_text
from hazardloom.rules import RuleBook, constant
from hazardloom.session import computed_if_read

HIGHEST_DISEASE_PROBABILITY = 0.95
HIGHEST_ORGAN_SCORE = 100.0


def disease_hits(matches: Column, rules: RuleBook) -> Column:
    """One struct per (match, disease of its alert), in match order.

    ``d`` numbers the disease and ``e`` the rule row; names and texts are looked up by
    them at the end, so the fold carries numbers only.
    """
    numbers: dict[str, int] = {}
    per_alert: dict[str, list[dict]] = {}
    for e, (_, alert, disease, base, _, _) in enumerate(rules.diseases):
        entry = {"d": numbers.setdefault(disease, len(numbers)), "e": e, "base": base}
        per_alert.setdefault(alert, []).append(entry)
    table = constant(
        [per_alert.get(a[1], []) for a in rules.alerts], "array<array<struct<d: int, e: int, base: double>>>"
    )

    def expand(m: Column) -> Column:
        return F.transform(
            F.get(table, m["ord"] - 1),
            lambda d: F.struct(
                d["d"].alias("d"),
                d["e"].alias("e"),
                F.least(
                    d["base"] * (F.lit(1.0) + F.lit(0.15) * (m["n"] - 1)), F.lit(HIGHEST_DISEASE_PROBABILITY)
                ).alias("p"),
            ),
        )

    return F.flatten(F.transform(matches, expand))


def organ_hits(matches: Column, rules: RuleBook) -> Column:
    """One struct per (match, tracked organ of its alert), in match order."""
    position = {organ: i for i, organ in enumerate(rules.organs)}
    per_alert: dict[str, list[dict]] = {}
    for _, alert, organ, score in rules.organ_scores:
        if organ in position:
            per_alert.setdefault(alert, []).append({"o": position[organ], "score": score})
    table = constant(
        [per_alert.get(a[1], []) for a in rules.alerts], "array<array<struct<o: int, score: double>>>"
    )

    def expand(m: Column) -> Column:
        return F.transform(
            F.get(table, m["ord"] - 1),
            lambda o: F.struct(
                o["o"].alias("o"),
                (o["score"] * (F.lit(1.0) + F.lit(0.1) * (m["n"] - 1))).alias("x"),
                m["ord"].alias("a"),
            ),
        )

    return F.flatten(F.transform(matches, expand))


def _fold_probability(hits: Column) -> Column:
    def step(a: Column, h: Column) -> Column:
        joined = F.least(
            F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - h["p"]), F.lit(HIGHEST_DISEASE_PROBABILITY)
        )
        return round_exact_once(F.when(a.isNull(), h["p"]).otherwise(joined), 3)

    return F.aggregate(hits, F.lit(None).cast("double"), step)


def _fold_score(hits: Column) -> Column:
    def step(s: Column, h: Column) -> Column:
        return F.least(F.lit(HIGHEST_ORGAN_SCORE), s + h["x"] * (F.lit(1.0) - s / 100.0))

    return F.aggregate(hits, F.lit(0.0), step)


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used several times in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def disease_risks(matches: Column, rules: RuleBook) -> Column:
    """Diseases of a match array, most probable first, first-seen on ties."""
    alert_of_row = constant([d[1] for d in rules.diseases], "array<string>")
    disease_of_row = constant([d[2] for d in rules.diseases], "array<string>")
    rank_of_row = constant([SEVERITY_RANK.get(d[4], 0) for d in rules.diseases], "array<int>")
    text_of_row = constant([d[5] for d in rules.diseases], "array<string>")

    def fold(hits: Column) -> Column:
        groups = F.transform(
            F.array_distinct(F.transform(hits, lambda h: h["d"])),
            lambda d: F.filter(hits, lambda h: h["d"] == d),
        )
        return F.transform(
            groups,
            lambda g, i: F.struct(
                (-_fold_probability(g)).alias("minus_p"),
                i.alias("seen"),
                F.array_distinct(F.transform(g, lambda h: h["e"])).alias("rows"),
            ),
        )

    return F.transform(
        F.sort_array(_bind(disease_hits(matches, rules), fold)),
        lambda d: F.struct(
            F.get(disease_of_row, d["rows"][0]).alias("disease"),
            (-d["minus_p"]).alias("probability"),
            severity_of_rank(F.array_max(F.transform(d["rows"], lambda e: F.get(rank_of_row, e)))).alias("severity"),
            F.array_distinct(F.transform(d["rows"], lambda e: F.get(alert_of_row, e))).alias("alerts"),
            F.get(text_of_row, d["rows"][0]).alias("description"),
        ),
    )


def organ_risks(matches: Column, rules: RuleBook) -> Column:
    """Organ risks of a match array, highest first, organ order on ties."""
    organs = constant(rules.organs, "array<string>")
    alerts = constant([a[1] for a in rules.alerts], "array<string>")

    def fold(hits: Column) -> Column:
        groups = F.transform(
            F.array_distinct(F.transform(hits, lambda h: h["o"])),
            lambda o: F.filter(hits, lambda h: h["o"] == o),
        )
        return F.transform(
            groups,
            lambda g: F.struct(
                (-round_exact_once(_fold_score(g), 1)).alias("minus_score"),
                g[0]["o"].alias("o"),
                F.array_distinct(F.transform(g, lambda h: h["a"])).alias("alerts"),
            ),
        )

    folded = _bind(organ_hits(matches, rules), fold)
    return F.transform(
        F.sort_array(F.filter(folded, lambda o: o["minus_score"] < 0)),
        lambda o: F.struct(
            F.get(organs, o["o"]).alias("organ"),
            (-o["minus_score"]).alias("score"),
            score_level(-o["minus_score"]).alias("level"),
            F.transform(o["alerts"], lambda a: F.get(alerts, a - 1)).alias("alerts"),
        ),
    )


def organ_map(risks: Column) -> Column:
    """Organ to score as a map."""
    return F.map_from_entries(
        F.transform(risks, lambda o: F.struct(o["organ"].alias("key"), o["score"].alias("value")))
    )


def top_diseases(diseases: Column, k: int = 5) -> Column:
    return F.slice(diseases, 1, k)


def disease_names(diseases: Column, k: int = 5) -> Column:
    """Names of the leading diseases as one comma list."""
    return F.array_join(F.transform(top_diseases(diseases, k), lambda d: d["disease"]), ", ")


def chart_rows(df: DataFrame, keys: list[str], organs: int = 10, diseases: int = 8) -> DataFrame:
    """The leading organs and diseases of each row as display rows."""

    def rows(array: str, kind: str, name: str, value: str, n: int) -> DataFrame:
        return df.select(*keys, F.posexplode(F.slice(F.col(array), 1, n)).alias("rank", "item")).select(
            *keys,
            F.lit(kind).alias("kind"),
            (F.col("rank") + 1).alias("rank"),
            F.col("item")[name].alias("name"),
            F.col("item")[value].alias("value"),
        )

    return rows("organ_risks", "organ", "organ", "score", organs).unionByName(
        rows("diseases", "disease", "disease", "probability", diseases)
    )


def health_summary(diseases: Column, organs_at_risk: Column) -> Column:
    """Sentence with the three leading diseases in whole percent and the three leading organs."""
    # --- fixed values: the sentence parts ---
    top = F.transform(
        F.slice(diseases, 1, 3),
        lambda d: F.concat(d["disease"], F.lit(" ("), percent_text(d["probability"]), F.lit(")")),
    )
    organs = F.array_join(F.transform(F.slice(organs_at_risk, 1, 3), lambda o: o["organ"]), ", ")
    risks = F.concat(F.lit("Top predicted health risks: "), F.array_join(top, ", "), F.lit("."))
    return (
        F.when(
            F.size(diseases) == 0,
            F.lit("No significant disease risks were identified based on structural analysis."),
        )
        .when(F.size(organs_at_risk) == 0, risks)
        .otherwise(F.concat(risks, F.lit(" Primary organs at risk: "), organs, F.lit(".")))
    )


def with_health(df: DataFrame, rules: RuleBook, matches: str = "matches") -> DataFrame:
    """Add ``diseases``, ``organ_risks`` and ``summary``: the full health report."""
    m = F.col(matches)
    reported = df.withColumns({"diseases": disease_risks(m, rules), "organ_risks": organ_risks(m, rules)})
    return computed_if_read(reported, ["diseases", "organ_risks"]).withColumn(
        "summary", health_summary(F.col("diseases"), F.col("organ_risks"))
    )

"""Matching, health, entity, mixture and batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as inp
from catalog.inputs import WORD_RULES
from catalog.sqlkit import (
    boosted,
    confidence,
    label,
    level,
    mean_sum,
    override,
    pyround,
    sql,
    text_literal,
)
from hazardloom.operators import health, lookups, match, mixture
from hazardloom.operators.match import match_rules
from hazardloom.plans import scoring
from hazardloom.session import spread
from hazardloom.rules import (
    CONTRAST_INTERACTION,
    MANY_ALERTS_INTERACTION,
    MODERATE_INTERACTION,
    NO_INTERACTION,
)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return inp.parts(spark, sf).withColumn("matches", match_rules(F.col("text"), WORD_RULES))


def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    return match.matches_long(matched(spark, sf), ["entity"])


def with_health(spark: SparkSession, sf: str) -> DataFrame:
    return health.with_health(matched(spark, sf), WORD_RULES)


def rule_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All rule tables joined, with the number of parts that match each alert."""
    rules = WORD_RULES
    diseases = rules.diseases_df(spark).groupBy("alert").agg(F.count("*").alias("n_diseases"))
    organs = (
        rules.organ_scores_df(spark)
        .join(rules.organs_df(spark).select("organ"), "organ", "left_semi")
        .groupBy("alert")
        .agg(F.count("*").alias("n_organs"), F.sum("score").alias("organ_sum"))
    )
    pairs = rules.pair_rules_df(spark)
    sides = pairs.select(F.col("alert_a").alias("alert")).unionByName(pairs.select(F.col("alert_b").alias("alert")))
    found = matched_rows(spark, sf).groupBy("alert").agg(F.count("*").alias("n_entities"))
    return (
        rules.alerts_df(spark)
        .join(rules.weights_df(spark).select("alert", "weight"), "alert", "left")
        .join(diseases, "alert", "left")
        .join(organs, "alert", "left")
        .join(sides.groupBy("alert").agg(F.count("*").alias("n_pair_rules")), "alert", "left")
        .join(found, "alert", "left")
        .na.fill(0, ["n_pair_rules", "n_entities"])
        .drop("pattern")
    )


def rule_match_table(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_rule_table(inp.parts(spark, sf), ["entity"], "text", WORD_RULES.alerts_df(spark))


def alert_disease_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = lookups.alert_diseases(matched_rows(spark, sf), WORD_RULES.diseases_df(spark))
    return joined.select("entity", "alert", "n", "disease_ord", "disease", "base_prob", "disease_severity")


def alert_organ_join(spark: SparkSession, sf: str) -> DataFrame:
    """Three organs are taken off the tracked list, so the membership test matters."""
    tracked = WORD_RULES.organs_df(spark).where(~F.col("organ").isin("Skin", "Heart", "Blood"))
    joined = lookups.alert_organs(matched_rows(spark, sf), WORD_RULES.organ_scores_df(spark), tracked)
    return joined.select("entity", "alert", "n", "organ", "organ_score")


def weight_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    weights = WORD_RULES.weights_df(spark).where(~F.col("alert").isin("Epoxide", "Azide"))
    joined = lookups.alert_weights(matched_rows(spark, sf), weights, WORD_RULES.default_weight)
    return joined.select("entity", "ord", "alert", "weight")


def report_fields(*names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = matched(spark, sf).withColumn("report", match.alert_report(F.col("matches"), WORD_RULES))
        return rows.select("entity", *[F.col(f"report.{n}").alias(n) for n in names])

    return run


def diminishing_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = matched(spark, sf).withColumn("override", match.override_floor(F.col("matches")))
    return rows.select(
        "entity",
        match.boosted_probability(F.col("base_p"), match.discounted_boost(F.col("matches")), F.col("override")).alias("p"),
    )


def flat(df: DataFrame, array: str, fields: list[str], n: int | None = None, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Array entries as rows with their rank from 1."""
    items = F.col(array) if n is None else F.slice(F.col(array), 1, n)
    rows = df.select(*keys, F.posexplode(items).alias("rank", "item"))
    columns = [
        F.array_join(F.col("item.alerts"), "; ").alias("alerts") if f == "alerts" else F.col(f"item.{f}").alias(f)
        for f in fields
    ]
    return rows.select(*keys, (F.col("rank") + 1).alias("rank"), *columns)


def organ_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_health(spark, sf).select("entity", health.organ_map(F.col("organ_risks")).alias("organ_map"))
    return rows.select("entity", F.explode("organ_map").alias("organ", "score"))


# --- entities and mixtures -----------------------------------------------------------
def scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    entities = spread(inp.parts(spark, sf), "entity")
    return scoring.score_entities(entities, "text", WORD_RULES, probabilities=inp.class_probabilities())


def score_entities(spark: SparkSession, sf: str) -> DataFrame:
    return scored_parts(spark, sf).select(
        "entity", "key", "probability", "raw_probability", "predicted_class", "label", "confidence",
        F.col("report.n_alerts").cast("long").alias("n_alerts"),
        "report.total_severity",
        "potency_estimate",
        "size_estimate",
        health.disease_names(F.col("diseases")).alias("diseases"),
        F.size("organ_risks").cast("long").alias("n_organs"),
    )


def single_report_row(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.report_rows(scored_parts(spark, sf), ["entity"])


def mixtures(spark: SparkSession, sf: str, with_report: bool = False) -> DataFrame:
    parts = spread(inp.parts(spark, sf).select("entity", "text"), "entity")
    dimension = scoring.match_dimension(parts, "text", WORD_RULES).drop("text")
    return scoring.score_mixture_rows(
        spread(inp.lines(spark, sf), "mix", "entity"), "mix", inp.line_order(), "text", F.col("base_p"), WORD_RULES,
        match_table=dimension, match_key="entity", health=with_report,
    )


def mixture_fields(**columns):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return mixtures(spark, sf).select("mix", *[F.col(c).alias(n) for n, c in columns.items()])

    return run


def truncate_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixture.truncate_components(inp.lines(spark, sf), "mix", inp.line_order())
    packed = mixture.collect_components(rows, "mix", F.lit(True), [F.col("entity")])
    return packed.select("mix", F.inline("components"))


def component_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = mixtures(spark, sf).select("mix", F.inline(mixture.component_pairs(F.col("components"))))
    return pairs


def pair_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    fired = mixture.fired_rules(F.col("rule_sets"), WORD_RULES)
    return mixtures(spark, sf).select("mix", F.inline(fired)).select("mix", "ord", "rule", "modifier")


def alert_set(spark: SparkSession, sf: str) -> DataFrame:
    named = mixture.alert_sets(F.col("rule_sets"), WORD_RULES)
    rows = mixtures(spark, sf).select("mix", F.posexplode(named).alias("i", "alerts"))
    return rows.select("mix", (F.col("i") + 1).alias("component"), F.array_join("alerts", "; ").alias("alerts"))


def score_mixtures(spark: SparkSession, sf: str) -> DataFrame:
    scored = mixtures(spark, sf, with_report=True)
    return scored.select(
        "mix",
        F.size("components").cast("long").alias("n"),
        F.col("interaction.type").alias("interaction"),
        F.col("interaction.modifier").alias("modifier"),
        "explanation",
        "final_probability",
        "label",
        "combined_confidence",
        "most_dangerous",
        "danger_level",
        health.disease_names(F.col("diseases")).alias("diseases"),
        F.size("organ_risks").cast("long").alias("n_organs"),
        F.round(
            F.aggregate(F.transform("organ_risks", lambda o: o["score"]), F.lit(0.0), lambda a, x: a + x), 4
        ).alias("organ_sum"),
    )


def detail_plus_total(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mixture_report(mixtures(spark, sf), "mix").withColumn("line", F.col("line").cast("int"))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    upload = spread(inp.uploads(spark, sf), "o_orderkey")
    return scoring.batch_route(upload, WORD_RULES, ["o_orderkey"], inp.text_base)


def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.top_terms(batch(spark, sf), "Diseases")


_report_sql = "SELECT entity, {} FROM report"
_disease_select = (
    "SELECT entity, rn AS rank, disease, probability, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][d.rank] AS severity, "
    "description, alerts FROM disease_ranked d"
)
_diseases_text = "string_agg(disease, ', ' ORDER BY rn) FILTER (rn <= 5)"
_explanation = (
    "SELECT p.entity, CASE WHEN r.n_alerts = 0 THEN 'No known toxic structural alerts were detected in this molecule.' ELSE "
    "'This molecule contains ' || CASE WHEN len(nm) = 1 THEN nm[1] WHEN len(nm) = 2 THEN nm[1] || ' and ' || nm[2] "
    "ELSE array_to_string(nm[1:len(nm)-1], ', ') || ', and ' || nm[len(nm)] END || ', which are ' || "
    "CASE WHEN sev[1] <= 3 THEN 'moderately' ELSE 'highly' END || ' associated with toxicity. Key mechanisms: ' || "
    "array_to_string(mech[1:2], '; ') || '.' END AS explanation FROM parts p JOIN report r USING (entity) LEFT JOIN "
    "(SELECT m.entity, list('**' || m.alert || '**' ORDER BY m.severity DESC, m.ord)[1:5] AS nm, "
    "list(m.severity ORDER BY m.severity DESC, m.ord) AS sev, list(r.mechanism ORDER BY m.severity DESC, m.ord) AS mech "
    "FROM matches m JOIN rules r USING (ord) GROUP BY m.entity) x USING (entity)"
)
_summary = (
    "SELECT p.entity, CASE WHEN d.entity IS NULL THEN 'No significant disease risks were identified based on structural analysis.' "
    "ELSE 'Top predicted health risks: ' || d.t || '.' || CASE WHEN o.entity IS NULL THEN '' ELSE ' Primary organs at risk: ' || o.t || '.' END END AS summary "
    "FROM parts p LEFT JOIN (SELECT entity, string_agg(disease || ' (' || round_even(probability * 100e0, 0)::INT || '%)', ', ' ORDER BY rn) AS t "
    "FROM disease_ranked WHERE rn <= 3 GROUP BY entity) d USING (entity) LEFT JOIN (SELECT entity, string_agg(organ, ', ' ORDER BY rn) AS t "
    "FROM organ_ranked WHERE rn <= 3 GROUP BY entity) o USING (entity)"
)
_interaction_text = (
    "CASE WHEN rule_text IS NOT NULL THEN rule_text WHEN min_p < 0.2e0 AND max_p > 0.6e0 THEN " + text_literal(CONTRAST_INTERACTION)
    + " WHEN moderate >= 2 THEN " + text_literal(MODERATE_INTERACTION)
    + " WHEN alert_rows >= 5 THEN " + text_literal(MANY_ALERTS_INTERACTION)
    + " ELSE " + text_literal(NO_INTERACTION) + " END"
)


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {pyround(x, digits)})"


_co = "(cap - e0) * least(0.1e0, 0.03e0 * distinct_alerts)"
_multi = "(cap - e1) * (CASE WHEN toxic_count = 2 THEN 0.06e0 ELSE 0.1e0 END)"
_esc_text = (
    f"'total_alert_score=' || {_fixed('weight', 2)} || ', normalized=' || {_fixed('weight / n', 3)} "
    f"|| CASE WHEN distinct_alerts >= 2 AND {_co} > 0 THEN '; co_occurrence_boost=' || {_fixed(_co, 3)} ELSE '' END "
    f"|| CASE WHEN toxic_count >= 2 AND {_multi} > 0 THEN '; multi_toxic_boost=' || {_fixed(_multi, 3)} ELSE '' END"
)
_final_text = f"{_interaction_text} || CASE WHEN escalated > combined THEN ' ' || {_esc_text} ELSE '' END"
_mean_conf = pyround("(" + mean_sum("confs") + ") / n * 0.9e0", 3)
_mix_score = (
    f"SELECT f.mix, n, kind AS interaction, modifier, {_final_text} AS explanation, final_p AS final_probability, {label('final_p')} AS label, "
    f"{_mean_conf} AS combined_confidence, most_dangerous, danger AS danger_level, coalesce(d.diseases, '') AS diseases, "
    "coalesce(o.n_organs, 0) AS n_organs, round(coalesce(o.organ_sum, 0e0), 4) AS organ_sum "
    "FROM mix_final f LEFT JOIN mix_top_diseases d USING (mix) LEFT JOIN "
    "(SELECT mix, count(*) AS n_organs, sum(score) AS organ_sum FROM mix_organ_risk WHERE score > 0 GROUP BY mix) o USING (mix)"
)

# Batch: the chosen component lists become mixtures of their own and go through the same steps.
_BATCH = {
    "b_rows": "SELECT o_orderkey, smiles, mixture, mix_parts AS given, CASE WHEN len(mix_parts[1:10]) >= 2 THEN 'Mixture' WHEN len(one_parts) >= 1 THEN 'Single' ELSE 'Error' END AS mode, "
    "CASE WHEN len(mix_parts[1:10]) >= 2 THEN mix_parts[1:10] WHEN len(one_parts) >= 1 THEN one_parts[1:1] ELSE [] END AS chosen FROM upload_parts",
    "b_comps0": "SELECT o_orderkey AS mix, i::INT AS pos, chosen[i] AS text, ((length(chosen[i]) * 7) % 20) / 20e0 AS base FROM b_rows, range(1, len(chosen) + 1) r(i)",
    "b_texts": "SELECT DISTINCT text FROM b_comps0",
    "b_matches": "SELECT * FROM (SELECT t.text, r.ord, r.alert, r.severity, r.boost, len(regexp_extract_all(t.text, r.pattern)) AS n FROM b_texts t, rules r) WHERE n > 0",
    "b_report": "SELECT t.text, count(m.ord) AS n_alerts, "
    + override("count(*) FILTER (m.severity >= 5)", "count(*) FILTER (m.severity >= 4)", "sum(m.severity * m.n)")
    + " AS floor_p, coalesce(list(m.boost ORDER BY m.boost DESC, m.ord) FILTER (m.ord IS NOT NULL), []) AS boosts FROM b_texts t LEFT JOIN b_matches m USING (text) GROUP BY t.text",
}


def _batch_sql(body: str) -> str:
    """The batch as SQL: mixture steps re-bound to the batch's components."""
    from catalog.sqlkit import BITS_SQL, COUNTS_SQL, CTES

    steps = dict(_BATCH)
    steps["b_feat"] = f"SELECT text, len(list_filter([{', '.join(COUNTS_SQL)}], lambda x: x <> 0)) + len({BITS_SQL}) AS nf FROM b_texts"
    steps["b_comps_p"] = (
        f"SELECT c.mix, c.pos, c.text AS key, r.n_alerts, f.nf + r.n_alerts AS n_available, {boosted('c.base', 'r.boosts', 'r.floor_p')} AS p "
        "FROM b_comps0 c JOIN b_report r USING (text) JOIN b_feat f USING (text)"
    )
    steps["comps"] = (
        f"SELECT mix, pos, key, n_alerts, {label('p')} AS label, {pyround('p', 4)} AS p, {confidence('p', 'n_alerts', 'n_available', '1067')} AS conf FROM b_comps_p"
    )
    steps["cmatches"] = "SELECT c.mix, c.pos, m.* FROM comps c JOIN b_matches m ON m.text = c.key"
    names = ["rules", "weights", "diseases", "pair_rules", "names", "name_map", "uploads", "upload_parts"]
    head = {n: CTES[n] for n in names} | steps
    for n in ("pair_fired", "pair_best", "mixes", "interactions", "combined", "mix_stats", "esc1", "esc2", "esc3", "esc",
              "mix_final", "mix_disease_hits", "mix_disease_risk", "mix_top_diseases"):
        head[n] = CTES[n]
    head["batch"] = (
        'SELECT b.o_orderkey, CASE WHEN mode = \'Mixture\' THEN b.mixture ELSE b.smiles END AS "Input", mode AS "Mode", '
        f"CASE mode WHEN 'Mixture' THEN {label('f.final_p')} WHEN 'Single' THEN c.label ELSE 'UNKNOWN' END AS \"Label\", "
        "CASE mode WHEN 'Mixture' THEN f.final_p WHEN 'Single' THEN f.max_p ELSE 0e0 END AS \"Probability\", "
        f"CASE mode WHEN 'Mixture' THEN {_mean_conf} WHEN 'Single' THEN confs[1] ELSE 0e0 END AS \"Confidence\", "
        "CASE mode WHEN 'Mixture' THEN f.kind ELSE 'N/A' END AS \"Interaction\", len(b.chosen)::INT AS \"N_Components\", "
        "CASE mode WHEN 'Mixture' THEN len(b.given) ELSE len(b.chosen) END::INT AS \"N_Given\", "
        "CASE mode WHEN 'Mixture' THEN f.danger WHEN 'Single' THEN least(10, trunc(f.max_p * 10e0)::INT + f.alert_rows) ELSE 0 END::INT AS \"Danger_Level\", "
        "coalesce(d.diseases, '') AS \"Diseases\", CASE mode WHEN 'Mixture' THEN f.most_dangerous ELSE '' END AS \"Most_Dangerous\" "
        "FROM b_rows b LEFT JOIN mix_final f ON f.mix = b.o_orderkey LEFT JOIN comps c ON c.mix = b.o_orderkey AND c.pos = 1 LEFT JOIN mix_top_diseases d ON d.mix = b.o_orderkey"
    )
    return "WITH " + ",\n".join(f"{n} AS ({c})" for n, c in head.items()) + "\n" + body


QUERIES: dict = {
    "rule_tables": (
        rule_tables,
        sql("SELECT r.ord, r.alert, r.severity, r.severity_label, r.boost, r.description, r.mechanism, w.weight, "
            "(SELECT count(*) FROM diseases d WHERE d.alert = r.alert) AS n_diseases, "
            "(SELECT count(*) FROM organs o WHERE o.alert = r.alert) AS n_organs, "
            "(SELECT sum(score) FROM organs o WHERE o.alert = r.alert) AS organ_sum, "
            "(SELECT count(*) FROM pair_rules q WHERE q.alert_a = r.alert) + (SELECT count(*) FROM pair_rules q WHERE q.alert_b = r.alert) AS n_pair_rules, "
            "(SELECT count(*) FROM matches m WHERE m.alert = r.alert) AS n_entities FROM rules r LEFT JOIN weights w USING (alert)"),
    ),
    "rule_match": (matched_rows, sql("SELECT entity, ord, alert, severity, boost, n FROM matches")),
    "rule_match_table": (rule_match_table, sql("SELECT entity, ord, alert, severity, boost, n FROM matches")),
    "alert_disease_join": (
        alert_disease_join,
        sql("SELECT m.entity, m.alert, m.n, dord AS disease_ord, disease, base_prob, d.severity AS disease_severity FROM matches m JOIN diseases d USING (alert)"),
    ),
    "alert_organ_join": (
        alert_organ_join,
        sql("SELECT m.entity, m.alert, m.n, organ, score AS organ_score FROM matches m JOIN organs o USING (alert) WHERE organ NOT IN ('Skin', 'Heart', 'Blood')"),
    ),
    "weight_lookup_default": (
        weight_lookup_default,
        sql("SELECT entity, ord, m.alert, CASE WHEN m.alert IN ('Epoxide', 'Azide') THEN 0.15e0 ELSE w.weight END AS weight FROM matches m JOIN weights w USING (alert)"),
    ),
    "alert_report": (
        report_fields("n_alerts", "total_severity", "has_critical", "max_severity"),
        sql(_report_sql.format("n_alerts::INT AS n_alerts, total_severity, has_critical, max_severity")),
    ),
    "override_floor": (report_fields("override_probability"), sql(_report_sql.format("override_probability"))),
    "diminishing_boost": (
        diminishing_boost,
        sql(f"SELECT p.entity, {boosted('p.base_p', 'r.boosts', 'r.override_probability')} AS p FROM parts p JOIN report r USING (entity)"),
    ),
    "alert_summary_rows": (
        lambda s, d: match.alert_summary_rows(matched(s, d), ["entity"], WORD_RULES),
        sql("SELECT m.entity, m.ord, m.alert AS \"Alert\", repeat('🔴', least(m.severity, 5)) || ' (' || m.severity || '/5)' AS \"Severity\", m.n AS \"Count\", "
            "r.description AS \"Description\", '+' || round_even(m.boost * 100e0, 0)::INT || '%' AS \"Probability Boost\" FROM matches m JOIN rules r USING (ord)"),
    ),
    "alert_explanation": (report_fields("explanation"), sql(_explanation)),
    "noisy_or_disease": (
        lambda s, d: flat(with_health(s, d), "diseases", ["disease", "probability"]).drop("rank"),
        sql("SELECT entity, disease, probability FROM disease_risk"),
    ),
    "disease_attributes": (
        lambda s, d: flat(with_health(s, d), "diseases", ["disease", "severity", "description", "alerts"]).drop("rank"),
        sql("SELECT entity, disease, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][d.rank] AS severity, description, alerts FROM disease_risk d"),
    ),
    "organ_saturation": (
        lambda s, d: flat(with_health(s, d), "organ_risks", ["organ", "score", "level", "alerts"]).drop("rank"),
        sql(f"SELECT entity, organ, score, {level('score')} AS level, alerts FROM organ_risk"),
    ),
    "organ_map": (organ_map, sql("SELECT entity, organ, score FROM organ_risk")),
    "topk_diseases": (
        lambda s, d: flat(with_health(s, d), "diseases", ["disease", "probability"], 5),
        sql("SELECT entity, rn::INT AS rank, disease, probability FROM disease_ranked WHERE rn <= 5"),
    ),
    "sort_risks": (
        lambda s, d: health.chart_rows(with_health(s, d), ["entity"], 15, 1000),
        sql("SELECT entity, 'organ' AS kind, rn::INT AS rank, organ AS name, score AS value FROM organ_ranked UNION ALL "
            "SELECT entity, 'disease', rn::INT, disease, probability FROM disease_ranked"),
    ),
    "chart_topn": (
        lambda s, d: health.chart_rows(with_health(s, d), ["entity"]),
        sql("SELECT entity, 'organ' AS kind, rn::INT AS rank, organ AS name, score AS value FROM organ_ranked WHERE rn <= 10 UNION ALL "
            "SELECT entity, 'disease', rn::INT, disease, probability FROM disease_ranked WHERE rn <= 8"),
    ),
    "health_summary": (lambda s, d: with_health(s, d).select("entity", "summary"), sql(_summary)),
    "join_list_text": (
        lambda s, d: with_health(s, d).select("entity", health.disease_names(F.col("diseases")).alias("diseases")),
        sql(f"SELECT p.entity, coalesce(t, '') AS diseases FROM parts p LEFT JOIN (SELECT entity, {_diseases_text} AS t FROM disease_ranked GROUP BY entity) USING (entity)"),
    ),
    "health_report": (
        lambda s, d: flat(with_health(s, d), "diseases", ["disease", "probability", "severity", "description", "alerts"], None, ("entity", "summary")),
        sql("SELECT x.*, s.summary FROM (" + _disease_select.replace("rn AS rank", "rn::INT AS rank") + f") x JOIN ({_summary}) s USING (entity)"),
    ),
    "score_entities": (
        score_entities,
        sql("SELECT s.entity, s.key, " + pyround("p", 4) + " AS probability, " + pyround("raw_p", 4) + " AS raw_probability, cls AS predicted_class, "
            + label("p") + " AS label, " + confidence("p", "n_alerts", "n_available", "1067") + " AS confidence, n_alerts, total_severity, "
            + pyround("4e0 + p * 5e0", 2) + " AS potency_estimate, length(s.key)::DOUBLE AS size_estimate, coalesce(t, '') AS diseases, coalesce(n_organs, 0) AS n_organs FROM "
            f"(SELECT p.entity, p.text AS key, c.raw_p, c.cls, r.n_alerts, r.total_severity, a.n_available, {boosted('c.base', 'r.boosts', 'r.override_probability')} AS p "
            "FROM parts p JOIN class_score c USING (entity) JOIN report r USING (entity) JOIN available a USING (entity)) s "
            f"LEFT JOIN (SELECT entity, {_diseases_text} AS t FROM disease_ranked GROUP BY entity) d USING (entity) "
            "LEFT JOIN (SELECT entity, count(*) AS n_organs FROM organ_risk GROUP BY entity) o USING (entity)"),
    ),
    "single_report_row": (
        single_report_row,
        sql("SELECT s.entity, s.key AS \"SMILES\", " + label("p") + ' AS "Toxicity Label", ' + pyround("p", 4) + ' AS "Toxicity Probability", '
            + confidence("p", "n_alerts", "n_available", "1067") + ' AS "Confidence", ' + pyround("4e0 + p * 5e0", 2)
            + ' AS "pIC50 Estimate", length(s.key)::DOUBLE AS "Text Length", n_alerts::INT AS "Structural Alerts", e.explanation AS "Explanation", coalesce(t, \'\') AS "Diseases" FROM '
            f"(SELECT p.entity, p.text AS key, r.n_alerts, a.n_available, {boosted('c.base', 'r.boosts', 'r.override_probability')} AS p "
            "FROM parts p JOIN class_score c USING (entity) JOIN report r USING (entity) JOIN available a USING (entity)) s "
            f"LEFT JOIN (SELECT entity, {_diseases_text} AS t FROM disease_ranked GROUP BY entity) d USING (entity) JOIN ({_explanation}) e USING (entity)"),
    ),
    "truncate_components": (
        truncate_components,
        sql("SELECT mix, pos, entity FROM lines QUALIFY count(*) OVER (PARTITION BY mix) >= 2"),
    ),
    "component_pairs": (
        component_pairs,
        sql("SELECT a.mix, a.pos AS pos_a, b.pos AS pos_b, a.key AS key_a, b.key AS key_b FROM comps a JOIN comps b ON a.mix = b.mix AND a.pos < b.pos"),
    ),
    "pair_rule_match": (pair_rule_match, sql("SELECT mix, ord, rule, modifier FROM pair_fired")),
    "alert_set": (
        alert_set,
        sql("SELECT c.mix, c.pos AS component, coalesce(string_agg(m.alert, '; ' ORDER BY m.alert), '') AS alerts FROM comps c LEFT JOIN matches m USING (entity) GROUP BY c.mix, c.pos"),
    ),
    "best_synergy_rule": (
        mixture_fields(rule="best_rule.rule", modifier="best_rule.modifier", explanation="best_rule.explanation"),
        sql("SELECT m.mix, b.rule, b.modifier, b.explanation FROM mixes m LEFT JOIN pair_best b USING (mix)"),
    ),
    "interaction_type": (
        mixture_fields(kind="interaction.type", modifier="interaction.modifier", explanation="interaction.explanation"),
        sql(f"SELECT mix, kind, modifier, {_interaction_text} AS explanation FROM interactions"),
    ),
    "mixture_combine": (mixture_fields(combined="combined"), sql("SELECT mix, combined FROM combined")),
    "mixture_confidence": (
        mixture_fields(confidence="combined_confidence"), sql(f"SELECT mix, {_mean_conf} AS confidence FROM mixes")
    ),
    "most_dangerous": (mixture_fields(most_dangerous="most_dangerous"), sql("SELECT mix, most_dangerous FROM mixes")),
    "mixture_alert_stats": (
        lambda s, d: mixtures(s, d).select(
            "mix", "stats.weight", F.col("stats.distinct_alerts").cast("long").alias("distinct_alerts"),
            F.col("stats.toxic_count").cast("long").alias("toxic_count"),
        ),
        sql("SELECT mix, weight, distinct_alerts, toxic_count FROM esc1"),
    ),
    "mixture_escalation": (
        mixture_fields(escalated="escalated", reason="escalation_text"),
        sql(f"SELECT mix, escalated, CASE WHEN weight > 0 THEN {_esc_text} ELSE '' END AS reason FROM esc"),
    ),
    "escalation_override": (
        mixture_fields(final_probability="final_probability", explanation="explanation"),
        sql(f"SELECT mix, final_p AS final_probability, {_final_text} AS explanation FROM mix_final"),
    ),
    "score_mixtures": (score_mixtures, sql(_mix_score)),
    "detail_plus_total": (
        detail_plus_total,
        sql(f"SELECT mix, pos AS line, key AS \"SMILES\", label AS \"Label\", p AS \"Probability\", conf AS \"Confidence\", n_alerts::VARCHAR AS \"Alerts\" FROM comps "
            f"UNION ALL SELECT mix, 11, '=== COMBINED ===', {label('final_p')}, final_p, {_mean_conf}, kind FROM mix_final"),
    ),
    "batch_route": (batch, _batch_sql("SELECT * FROM batch")),
    "batch_summary": (
        lambda s, d: scoring.batch_summary(batch(s, d)).withColumn("avg_probability", F.round("avg_probability", 6)),
        _batch_sql("SELECT count(*) AS total, count(*) FILTER (\"Label\" IN ('TOXIC', 'HIGH RISK', 'CRITICAL')) AS toxic_plus, "
                   "round(avg(\"Probability\"), 6) AS avg_probability, max(\"Danger_Level\") AS max_danger FROM batch"),
    ),
    "label_distribution": (
        lambda s, d: scoring.label_distribution(batch(s, d)),
        _batch_sql('SELECT "Label", count(*) AS n FROM batch GROUP BY "Label"'),
    ),
    "top_terms": (
        top_terms,
        _batch_sql("SELECT trim(t) AS term, count(*) AS n FROM (SELECT unnest(string_split(\"Diseases\", ',')) AS t FROM batch WHERE \"Diseases\" <> '') GROUP BY term ORDER BY n DESC, term LIMIT 10"),
    ),
}

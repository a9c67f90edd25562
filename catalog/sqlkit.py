"""SQL side: shared table expressions of the counterpart queries."""

from __future__ import annotations

import re

from catalog.inputs import WORD_RULES, WORDS
from hazardloom.functions.text import COUNT_FEATURES, GRAM_BASE, GRAM_FACTOR, GRAM_PRIME, WHITESPACE
from hazardloom.operators.clean import ASSAYS


TRIM_PATTERN = rf"^{WHITESPACE}+|{WHITESPACE}+$"


def text_literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value)


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(text_literal(v) for v in row) + ")" for row in rows)


def pyround(x: str, digits: int) -> str:
    """Round by the exact binary value, ties to even (as the Spark side does)."""
    s, c = f"1e{digits}", "134217729e0"
    high = f"(v * {c} - (v * {c} - v))"
    rest, error = f"(v * {s} - floor(v * {s}))", f"(({high} * {s} - v * {s}) + (v - {high}) * {s})"
    up = (
        f"{rest} > 0.5e0 OR ({rest} = 0.5e0 AND ({error} > 0 OR "
        f"({error} = 0 AND abs(floor(v * {s}) % 2e0) = 1)))"
    )
    body = f"CASE WHEN {up} THEN floor(v * {s}) + 1e0 ELSE floor(v * {s}) END / {s}"
    return f"list_extract(list_transform([({x})::DOUBLE], lambda v: {body}), 1)"


def nkey(x: str) -> str:
    """Normalised key."""
    stripped = f"regexp_replace({x}, {text_literal(TRIM_PATTERN)}, '', 'g')"
    return f"nullif(replace(replace({stripped}, chr(10), ''), chr(13), ''), '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {text_literal(TRIM_PATTERN)}, '', 'g')"


def label(p: str) -> str:
    return (
        f"CASE WHEN {p} < 0.2::DOUBLE THEN 'NON-TOXIC' WHEN {p} < 0.4::DOUBLE THEN 'MODERATE' "
        f"WHEN {p} < 0.6::DOUBLE THEN 'TOXIC' WHEN {p} < 0.8::DOUBLE THEN 'HIGH RISK' "
        f"WHEN {p} IS NOT NULL THEN 'CRITICAL' END"
    )


def level(s: str) -> str:
    return (
        f"CASE WHEN {s} >= 70 THEN 'CRITICAL' WHEN {s} >= 50 THEN 'HIGH' "
        f"WHEN {s} >= 25 THEN 'MODERATE' ELSE 'LOW' END"
    )


def rank(s: str) -> str:
    return f"CASE {s} WHEN 'LOW' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"


def confidence(p: str, n: str, avail: str, total: str) -> str:
    blended = (
        f"least(abs({p} - 0.5e0) * 2e0, 1e0) * 0.5e0 "
        f"+ least(({avail})::DOUBLE / greatest({total}, 1)::DOUBLE, 1e0) * 0.3e0 "
        f"+ (CASE WHEN {p} > 0.5e0 THEN least(({n})::DOUBLE * 0.05e0, 0.2e0) ELSE 0e0 END) * 0.2e0"
    )
    return pyround(f"least(greatest({blended}, 0e0), 1e0)", 3)


def fold(items: str, step: str, start: str) -> str:
    """Left fold of a list of doubles from ``start``."""
    return f"list_reduce({items}, lambda a, b: {step}, {start})"


def mean_sum(xs: str) -> str:
    """Sum in the fixed order of the mixture means."""
    eight = f"((({xs}[1] + {xs}[2]) + ({xs}[3] + {xs}[4])) + (({xs}[5] + {xs}[6]) + ({xs}[7] + {xs}[8])))"
    return f"CASE WHEN len({xs}) >= 8 THEN {fold(f'{xs}[9:]', 'a + b', eight)} ELSE {fold(xs, 'a + b', '0e0')} END"


def override(crit: str, high: str, total: str) -> str:
    return (
        f"CASE WHEN {crit} >= 2 THEN 0.95e0 WHEN {crit} >= 1 THEN 0.8e0 WHEN {high} >= 3 THEN 0.85e0 "
        f"WHEN {high} >= 2 THEN 0.7e0 WHEN {total} >= 12 THEN 0.65e0 END"
    )


def boosted(base: str, boosts: str, floor_: str) -> str:
    """``boosts`` is a list of boosts, largest first (NULL or empty without matches)."""
    terms = f"list_transform({boosts}, lambda b, i: b * (1e0 / (1e0 + (i - 1) * 0.5e0)))"
    total = fold(terms, "a + b", "0e0")
    raised = f"least({pyround(f'{base} + {total} * (1e0 - {base})', 4)}, 0.999e0)"
    return (
        f"CASE WHEN {floor_} IS NOT NULL THEN greatest({base}, {floor_}) "
        f"WHEN coalesce(len({boosts}), 0) = 0 THEN {base} ELSE {raised} END"
    )


DISEASE_STEP = pyround("least(1e0 - (1e0 - a) * (1e0 - b), 0.95e0)", 3)
ORGAN_STEP = "least(100e0, a + b * (1e0 - a / 100e0))"


def disease_fold(ps: str) -> str:
    return fold(f"({ps})[2:]", DISEASE_STEP, pyround(f"list_extract({ps}, 1)", 3))


def word(shift: int) -> str:
    at = f"((o_orderkey // {shift + 1} + o_custkey * {shift + 3}) % 16)"
    return f"list_extract([{', '.join(text_literal(w) for w in WORDS)}], ({at} + 1)::INT)"


def parts_of(x: str) -> str:
    """Component list of a mixture text; ``m`` is the map of known names."""
    s = strip(f"coalesce({x}, '')")
    raw = f"CASE WHEN contains({s}, ',') THEN string_split({s}, ',') ELSE string_split({s}, '.') END"
    resolved = nkey(f"coalesce(map_extract_value(m, lower({strip('t')})), t)")
    return f"list_filter(list_transform({raw}, lambda t: {resolved}), lambda t: t IS NOT NULL)"


_probs = ", ".join(f"((p_size * {i + 3}) % 7 + 1)::DOUBLE" for i in range(5))
_cells = ", ".join(
    f"CASE WHEN (doc_id + {i}) % 4 <> 0 THEN ((doc_id * 7 + {i * 3} + quality + toxic * 2) % 5 = 0)::INT::DOUBLE END "
    f'AS "{a}"'
    for i, a in enumerate(ASSAYS)
)
_assay_sum = " + ".join(f'coalesce("{a}", 0)' for a in ASSAYS)
_assay_n = " + ".join(f'("{a}" IS NOT NULL)::INT' for a in ASSAYS)


def _count_sql(name: str, kind: str, what: str) -> str:
    words = "regexp_extract_all(text, '[A-Za-z0-9]+')"
    if name == "n_chars":
        return "length(text)"
    if name == "n_distinct_words":
        return f"len(list_distinct(list_transform({words}, lambda w: lower(w))))"
    if name == "longest_word":
        return f"coalesce(list_max(list_transform({words}, lambda w: length(w))), 0)"
    pattern = "|".join(re.escape(c) for c in what) if kind == "characters" else what
    return f"len(regexp_extract_all(text, {text_literal(pattern)}))"


COUNTS_SQL = [f"({_count_sql(n, *spec)})::DOUBLE" for n, spec in COUNT_FEATURES.items()]


def grams(n: int) -> str:
    """Numbers of the n-grams: code points plus one as digits."""
    value = "(unicode(substr(text, i, 1))::BIGINT + 1)"
    for k in range(1, n):
        value = f"({value} * {GRAM_BASE} + unicode(substr(text, i + {k}, 1)) + 1)"
    return f"list_transform(range(1, length(text) - {n - 2}), lambda i: {value})"


BITS_SQL = (
    f"list_sort(list_distinct(list_transform(list_concat(list_concat({grams(1)}, {grams(2)}), {grams(3)}), "
    f"lambda g: (((g % {GRAM_PRIME}) * {GRAM_FACTOR}) % {GRAM_PRIME} % 1024)::INT)))"
)

_k = "o_orderkey % 10"
_pair = f"{word(0)} || ' ' || {word(1)}"

# name -> SQL body; bodies name other entries they use, which are pulled in before them.
CTES: dict[str, str] = {
    "rules": "SELECT * FROM (" + values(WORD_RULES.alerts)
    + ") t(ord, alert, pattern, severity, severity_label, boost, description, mechanism)",
    "weights": "SELECT * FROM (" + values(list(WORD_RULES.weights.items())) + ") t(alert, weight)",
    "diseases": "SELECT * FROM (" + values(WORD_RULES.diseases)
    + ") t(dord, alert, disease, base_prob, severity, description)",
    "organs": "SELECT * FROM (" + values(WORD_RULES.organ_scores) + ") t(oord, alert, organ, score)",
    "organ_list": "SELECT * FROM (" + values([(i + 1, o) for i, o in enumerate(WORD_RULES.organs)]) + ") t(pos, organ)",
    "pair_rules": "SELECT * FROM (" + values(WORD_RULES.pair_rules)
    + ") t(ord, rule, alert_a, alert_b, modifier, explanation)",
    "class_labels": "SELECT * FROM (" + values(list(enumerate(WORD_RULES.labels))) + ") t(class, label)",
    "names": "SELECT * FROM (" + values([(i + 1, n, s) for i, (n, s) in enumerate(WORD_RULES.names.items())])
    + ") t(ord, name, structure)",
    "name_map": "SELECT map_from_entries(list({k: name, v: structure})) AS m FROM names",
    "parts": "SELECT p_partkey AS entity, lower(p_name || ' ' || p_type) AS text, p_size, "
    f"(p_size - 1) / 49e0 AS base_p, [{_probs}] AS raw_probs FROM part",
    "probs": "SELECT entity, list_transform(raw_probs, lambda x: x / list_reduce(raw_probs, lambda a, b: a + b)) AS probs FROM parts",
    "class_score": "SELECT entity, list_max(probs) AS raw_p, (list_position(probs, list_max(probs)) - 1)::INT AS cls, "
    "(((probs[1] * 0e0 + probs[2] * 0.25e0) + probs[3] * 0.5e0) + probs[4] * 0.75e0) + probs[5] * 1e0 AS base FROM probs",
    "matches": "SELECT entity, ord, alert, severity, boost, n::INT AS n FROM (SELECT p.entity, r.ord, r.alert, "
    "r.severity, r.boost, len(regexp_extract_all(p.text, r.pattern)) AS n FROM parts p, rules r) WHERE n > 0",
    "report": "SELECT p.entity, count(m.ord) AS n_alerts, coalesce(sum(m.severity * m.n), 0)::BIGINT AS total_severity, "
    "coalesce(bool_or(m.severity >= 4), false) AS has_critical, coalesce(max(m.severity), 0) AS max_severity, "
    f"{override('count(*) FILTER (m.severity >= 5)', 'count(*) FILTER (m.severity >= 4)', 'sum(m.severity * m.n)')} "
    "AS override_probability, coalesce(list(m.boost ORDER BY m.boost DESC, m.ord) FILTER (m.ord IS NOT NULL), []) AS boosts "
    "FROM parts p LEFT JOIN matches m USING (entity) GROUP BY p.entity",
    "disease_hits": "SELECT m.entity, m.ord * 100 + d.dord AS o, m.alert, d.disease, d.severity, d.description, "
    "least(d.base_prob * (1e0 + 0.15e0 * (m.n - 1)), 0.95e0) AS p FROM matches m JOIN diseases d USING (alert)",
    "disease_risk": f"SELECT entity, disease, {disease_fold('list(p ORDER BY o)')} AS probability, "
    f"max({rank('severity')}) AS rank, arg_min(description, o) AS description, "
    "list_distinct(list(alert)) AS alert_set, string_agg(alert, '; ' ORDER BY o) AS alerts, min(o) AS seen "
    "FROM disease_hits GROUP BY entity, disease",
    "disease_ranked": "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY probability DESC, seen) AS rn FROM disease_risk",
    "organ_risk": f"SELECT * FROM (SELECT m.entity, o.organ, l.pos, "
    f"{pyround(fold('list(o.score * (1e0 + 0.1e0 * (m.n - 1)) ORDER BY m.ord)', ORGAN_STEP, '0e0'), 1)} AS score, "
    "string_agg(m.alert, '; ' ORDER BY m.ord) AS alerts "
    "FROM matches m JOIN organs o USING (alert) JOIN organ_list l USING (organ) GROUP BY m.entity, o.organ, l.pos) WHERE score > 0",
    "organ_ranked": "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, pos) AS rn FROM organ_risk",
    "feat": f"SELECT entity, text, [{', '.join(COUNTS_SQL)}] AS counts, {BITS_SQL} AS bits FROM parts",
    "available": "SELECT f.entity, len(list_filter(f.counts, lambda x: x <> 0)) + len(f.bits) + r.n_alerts AS n_available "
    "FROM feat f JOIN report r USING (entity)",
    "lines": "SELECT * FROM (SELECT l_orderkey AS mix, l_partkey AS entity, l_discount * 10e0 AS base, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS pos "
    "FROM lineitem) WHERE pos <= 10",
    "comps_all": "SELECT l.mix, l.pos, l.entity, p.text AS key, a.n_available, r.n_alerts, "
    f"{boosted('l.base', 'r.boosts', 'r.override_probability')} AS p "
    "FROM lines l JOIN parts p USING (entity) JOIN report r USING (entity) JOIN available a USING (entity)",
    "comps": f"SELECT mix, pos, entity, key, n_alerts, {label('p')} AS label, {pyround('p', 4)} AS p, "
    f"{confidence('p', 'n_alerts', 'n_available', '1067')} AS conf FROM comps_all "
    "QUALIFY count(*) OVER (PARTITION BY mix) >= 2",
    "cmatches": "SELECT c.mix, c.pos, m.* FROM comps c JOIN matches m USING (entity)",
    "pair_fired": "SELECT DISTINCT a.mix, r.ord, r.rule, r.modifier, r.explanation FROM pair_rules r "
    "JOIN cmatches a ON a.alert = r.alert_a JOIN cmatches b ON b.alert = r.alert_b AND a.mix = b.mix AND a.pos <> b.pos",
    "pair_best": "SELECT mix, arg_min(rule, rk) AS rule, arg_min(modifier, rk) AS modifier, arg_min(explanation, rk) AS explanation "
    "FROM (SELECT *, row_number() OVER (PARTITION BY mix ORDER BY modifier DESC, ord) AS rk FROM pair_fired) GROUP BY mix",
    "mixes": "SELECT mix, count(*) AS n, min(p) AS min_p, max(p) AS max_p, list(p ORDER BY pos) AS ps, list(conf ORDER BY pos) AS confs, "
    "count(*) FILTER (p > 0.3e0 AND p < 0.6e0) AS moderate, sum(n_alerts)::BIGINT AS alert_rows, "
    "sum((n_alerts >= 2)::INT + (p >= 0.35e0)::INT)::BIGINT AS toxic_count, arg_min(key, o) AS most_dangerous "
    "FROM (SELECT *, row_number() OVER (PARTITION BY mix ORDER BY p DESC, pos) AS o FROM comps) GROUP BY mix",
    "interactions": "SELECT m.*, "
    "CASE WHEN b.mix IS NOT NULL THEN 'SYNERGISTIC' WHEN min_p < 0.2e0 AND max_p > 0.6e0 THEN 'ADDITIVE' "
    "WHEN moderate >= 2 THEN 'ADDITIVE' WHEN alert_rows >= 5 THEN 'SYNERGISTIC' ELSE 'INDEPENDENT' END AS kind, "
    "CASE WHEN b.mix IS NOT NULL THEN b.modifier WHEN min_p < 0.2e0 AND max_p > 0.6e0 THEN 1e0 "
    "WHEN moderate >= 2 THEN 1.1e0 WHEN alert_rows >= 5 THEN 1.2e0 ELSE 1e0 END AS modifier, b.explanation AS rule_text "
    "FROM mixes m LEFT JOIN pair_best b USING (mix)",
    "combined": "SELECT *, least(" + pyround(
        "CASE kind WHEN 'SYNERGISTIC' THEN (1e0 - " + fold("ps", "a * (1e0 - b)", "1e0") + ") * modifier "
        "WHEN 'ADDITIVE' THEN (" + mean_sum("ps") + ") / n * modifier ELSE max_p END", 4
    ) + ", 0.999e0) AS combined FROM interactions",
    "mix_stats": "SELECT mix, " + fold("list(coalesce(w.weight, 0.15e0) ORDER BY pos, ord)", "a + b", "0e0")
    + " AS weight, count(DISTINCT alert) AS distinct_alerts FROM cmatches c LEFT JOIN weights w USING (alert) GROUP BY mix",
    "esc1": "SELECT c.*, coalesce(s.weight, 0e0) AS weight, coalesce(s.distinct_alerts, 0) AS distinct_alerts, "
    "least(max_p + 0.15e0, 0.95e0) AS cap FROM combined c LEFT JOIN mix_stats s USING (mix)",
    "esc2": "SELECT *, least(max_p * (1e0 + least(weight / n * 0.5e0, 0.25e0)), cap) AS e0 FROM esc1",
    "esc3": "SELECT *, CASE WHEN distinct_alerts >= 2 THEN least(e0 + (cap - e0) * least(0.1e0, 0.03e0 * distinct_alerts), cap) "
    "ELSE e0 END AS e1 FROM esc2",
    "esc": "SELECT *, CASE WHEN weight > 0 THEN " + pyround(
        "CASE WHEN toxic_count >= 2 THEN least(e1 + (cap - e1) * (CASE WHEN toxic_count = 2 THEN 0.06e0 ELSE 0.1e0 END), cap) ELSE e1 END", 4
    ) + " ELSE 0e0 END AS escalated FROM esc3",
    "mix_final": "SELECT *, greatest(combined, escalated) AS final_p, "
    "least(10, greatest(1, trunc(greatest(combined, escalated) * 10e0)::INT + alert_rows))::INT AS danger FROM esc",
    "mix_disease_hits": "SELECT c.mix, c.pos * 10000 + c.ord * 100 + d.dord AS o, c.alert, d.disease, d.severity, d.description, "
    "least(d.base_prob * (1e0 + 0.15e0 * (c.n - 1)), 0.95e0) AS p FROM cmatches c JOIN diseases d USING (alert)",
    "mix_disease_risk": f"SELECT mix, disease, {disease_fold('list(p ORDER BY o)')} AS probability, "
    f"max({rank('severity')}) AS rank, min(o) AS seen FROM mix_disease_hits GROUP BY mix, disease",
    "mix_top_diseases": "SELECT mix, string_agg(disease, ', ' ORDER BY rn) FILTER (rn <= 5) AS diseases, "
    "sum(probability) AS p_sum FROM (SELECT *, row_number() "
    "OVER (PARTITION BY mix ORDER BY probability DESC, seen) AS rn FROM mix_disease_risk) GROUP BY mix",
    "mix_organ_risk": f"SELECT c.mix, o.organ, {pyround(fold('list(o.score * (1e0 + 0.1e0 * (c.n - 1)) ORDER BY c.pos, c.ord)', ORGAN_STEP, '0e0'), 1)} AS score "
    "FROM cmatches c JOIN organs o USING (alert) JOIN organ_list l USING (organ) GROUP BY c.mix, o.organ",
    "assays": f"SELECT doc_id, text AS smiles, {_cells} FROM documents JOIN labels USING (doc_id)",
    "assays_all": f"SELECT doc_id, {_cells} FROM documents LEFT JOIN labels USING (doc_id)",
    "library": "SELECT doc_id AS lib_id, text AS smiles, n_chars / 100e0 AS logP, "
    'CASE WHEN n_chars % 5 <> 0 THEN (n_chars % 97) / 97e0 END AS qed, CASE WHEN lang <> \'fr\' THEN (n_chars % 11)::DOUBLE END AS "SAS" FROM documents',
    "raw_events": "SELECT *, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'NaN' "
    "WHEN event_id % 13 = 0 THEN '-' || value::VARCHAR ELSE value::VARCHAR END AS value_text FROM events",
    "clean_events": "SELECT *, CASE WHEN isfinite(TRY_CAST(value_text AS DOUBLE)) THEN TRY_CAST(value_text AS DOUBLE) END AS num FROM raw_events",
    "measured": f"SELECT sha256({nkey('d.text')}) AS key, e.num FROM clean_events e JOIN documents d ON d.doc_id = e.user_id "
    f"WHERE event_type = 'purchase' AND num > 0 AND {nkey('d.text')} IS NOT NULL",
    "measured_stats": "SELECT key, avg(-log10(num * 1e-9)) AS p, median(num) AS m, count(*) AS n FROM measured GROUP BY key",
    "base0": f"SELECT *, sha256({nkey('smiles')}) AS key FROM assays",
    "base": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM base0 WHERE key IS NOT NULL) WHERE rn = 1",
    "base_hits": f"SELECT *, ({_assay_sum})::INT AS hits, ({_assay_n})::INT AS tested FROM base",
    "lib0": f"SELECT *, sha256({nkey('smiles')}) AS key FROM library",
    "lib": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lib_id) AS rn FROM lib0 WHERE key IS NOT NULL) WHERE rn = 1",
    "all_hits": f"SELECT doc_id, ({_assay_sum})::INT AS hits, ({_assay_n})::INT AS tested FROM assays_all",
    "uploads": f"SELECT o_orderkey, CASE {_k} WHEN 3 THEN {word(1)} || ' ' || {word(5)} WHEN 5 THEN 'ANILINE ' "
    f"WHEN 6 THEN {_pair} || ', ' || {word(3)} WHEN 7 THEN ' , ' WHEN 8 THEN chr(10) || {_pair} || ' ' || {word(6)} || ' ' END AS smiles, "
    f"CASE {_k} WHEN 0 THEN {_pair} || ', ' || {word(2)} || ' ,' || {word(3)} WHEN 1 THEN {word(0)} || '.' || {word(4)} "
    f"WHEN 2 THEN ' Benzene,  ,' || {_pair} WHEN 3 THEN {word(2)} WHEN 4 THEN "
    + " || ',' || ".join(word(i) for i in range(12))
    + " WHEN 5 THEN '  ' END AS mixture FROM orders",
    "upload_parts": f"SELECT o_orderkey, smiles, mixture, {parts_of('mixture')} AS mix_parts, {parts_of('smiles')} AS one_parts "
    "FROM uploads, name_map",
    "classified": "SELECT o_orderkey, o_orderstatus AS model, substr(o_orderpriority, 1, 1)::INT - 1 AS y, "
    "least(floor(o_totalprice / 125000e0), 4)::INT AS yhat, ["
    + ", ".join(f"(floor(o_totalprice)::BIGINT % {1000 + c}) / {1000 + c}e0" for c in range(5))
    + "] AS scores FROM orders",
    "ovr": "SELECT o_orderkey, c::INT AS class, (y = c)::INT AS is_class, scores[c + 1] AS score FROM classified, range(5) r(c)",
    "ties": "SELECT class, score, sum(is_class) AS pos, sum(1 - is_class) AS neg FROM ovr GROUP BY class, score",
    "cum": "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS P, "
    "sum(neg) OVER (PARTITION BY class) AS N FROM ties WINDOW w AS (PARTITION BY class ORDER BY score DESC) QUALIFY P > 0",
    "grid": "SELECT a.y::INT AS y, b.yhat::INT AS yhat FROM range(5) a(y), range(5) b(yhat)",
    "confusion": "SELECT g.model, g.y, g.yhat, count(c.y) AS n FROM (SELECT * FROM (SELECT DISTINCT model FROM classified), grid) g "
    "LEFT JOIN classified c USING (model, y, yhat) GROUP BY ALL",
    "class_scores": "SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1_score "
    "FROM (SELECT model, class, support, hits, CASE WHEN predicted = 0 THEN 0e0 ELSE hits / predicted::DOUBLE END AS precision, "
    "CASE WHEN support = 0 THEN 0e0 ELSE hits / support::DOUBLE END AS recall FROM (SELECT model, c AS class, "
    "sum(n) FILTER (y = c) AS support, sum(n) FILTER (yhat = c) AS predicted, sum(n) FILTER (y = c AND yhat = c) AS hits "
    "FROM confusion, range(5) r(c) GROUP BY model, c))",
    "vecs": "SELECT vec_id, embedding, (label % 5)::INT AS cls FROM embeddings",
    "cells": "SELECT vec_id, cls, (i - 1)::INT AS feature, embedding[i]::DOUBLE AS x FROM vecs, range(1, 65) r(i)",
    "weights_lin": "SELECT feature, round(covar_pop(cls, x) / var_pop(x), 6) AS weight, round(avg(x), 6) AS mean FROM cells GROUP BY feature",
    "contrib": "SELECT c.*, w.weight * (c.x - w.mean) AS c FROM cells c JOIN weights_lin w USING (feature)",
    "vsample": "SELECT vec_id FROM vecs ORDER BY md5('42:' || vec_id)",
    "importance": "SELECT feature, avg(abs(c)) AS importance FROM contrib JOIN vsample USING (vec_id) GROUP BY feature",
}


def _needs(body: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+\(?\s*(?:SELECT DISTINCT \w+ FROM )?([a-z_0-9]+)", body))
    return [w for w in CTES if w in words]


def sql(body: str) -> str:
    """Put the shared expressions a body uses in front of it."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in seen:
                seen.add(name)
                visit(CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body

"""Matching, health and mixtures against plain Python on random and hand-made cases."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.operators import health, match, mixture
from hazardloom.plans import scoring
from hazardloom.rules import RuleBook
from hazardloom.session import computed_if_read

RULES = RuleBook.default()
MATCH_TYPE = "array<struct<ord: int, alert: string, severity: int, boost: double, n: int>>"
COMPONENT_TYPE = (
    "array<struct<pos: int, key: string, probability: double, confidence: double, matches: array<struct<ord: int, n: int>>>>"
)


def entry(ord_, n=1):
    a = RULES.alerts[ord_ - 1]
    return (a[0], a[1], a[3], a[5], n)


def random_matches(rng, most=16):
    chosen = sorted(rng.sample(range(1, 17), rng.randint(0, most)))
    return [entry(o, rng.choice([1, 1, 1, 2, 3, 7])) for o in chosen]


def floor_of(found):
    critical = sum(m[2] >= 5 for m in found)
    high = sum(m[2] >= 4 for m in found)
    for holds, value in ((critical >= 2, 0.95), (critical >= 1, 0.80), (high >= 3, 0.85), (high >= 2, 0.70),
                         (sum(m[2] * m[4] for m in found) >= 12, 0.65)):
        if found and holds:
            return value
    return None


def boosted_of(base, found):
    floor = floor_of(found)
    if floor is not None:
        return max(base, floor)
    if not found:
        return base
    total = 0.0
    for i, b in enumerate(sorted((m[3] for m in found), reverse=True)):
        total += b * (1.0 / (1 + i * 0.5))
    return min(round(base + total * (1 - base), 4), 0.999)


def test_report_and_boost(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), random_matches(rng, rng.choice([0, 1, 2, 3, 16]))) for i in range(400)]
    rows += [(1000, 0.1, [entry(10), entry(2), entry(3), entry(4)]), (1001, 0.1, [entry(5, 4)]), (1002, 0.1, [])]
    df = spark.createDataFrame(rows, f"id int, base double, matches {MATCH_TYPE}")
    m = F.col("matches")
    got = df.withColumn("override", match.override_floor(m)).select(
        "id", match.n_alerts(m), match.total_severity(m), match.has_critical(m), match.max_severity(m), "override",
        match.boosted_probability(F.col("base"), match.discounted_boost(m), F.col("override")),
    )
    for r in got.collect():
        _, base, found = next(x for x in rows if x[0] == r[0])
        assert r[1] == len(found)
        assert r[2] == sum(x[2] * x[4] for x in found)
        assert r[3] == any(x[2] >= 4 for x in found)
        assert r[4] == max((x[2] for x in found), default=0)
        assert r[5] == floor_of(found)
        assert r[6] == boosted_of(base, found)
        assert 0 <= r[6] <= 0.999 or r[6] == base
    by_id = {r[0]: r for r in got.collect()}
    assert by_id[1000][5] == 0.80  # one critical alert outranks three high ones
    assert by_id[1001][5] == 0.65
    assert by_id[1002][5] is None


def health_of(found):
    diseases, organs = OrderedDict(), {}
    for m in found:
        for _, alert, disease, base, severity, text in RULES.diseases:
            if alert != m[1]:
                continue
            p = min(base * (1 + 0.15 * (m[4] - 1)), 0.95)
            rank = ["LOW", "MODERATE", "HIGH", "CRITICAL"].index(severity)
            if disease in diseases:
                d = diseases[disease]
                d["p"] = round(min(1 - (1 - d["p"]) * (1 - p), 0.95), 3)
                d["rank"] = max(d["rank"], rank)
                if alert not in d["alerts"]:
                    d["alerts"].append(alert)
            else:
                diseases[disease] = {"p": round(p, 3), "rank": rank, "alerts": [alert], "text": text}
        for _, alert, organ, score in RULES.organ_scores:
            if alert == m[1]:
                s = organs.get(organ, 0.0)
                organs[organ] = min(100, s + score * (1 + 0.1 * (m[4] - 1)) * (1 - s / 100))
    ranked = sorted(diseases.items(), key=lambda d: -d[1]["p"])
    risks = [(o, round(organs[o], 1)) for o in RULES.organs if round(organs.get(o, 0.0), 1) > 0]
    return ranked, sorted(risks, key=lambda o: -o[1])


def test_health_against_python(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        found = []
        for _ in range(rng.choice([0, 1, 1, 3])):  # several components: alerts repeat
            found += random_matches(rng, rng.choice([1, 4, 16]))
        rows.append((i, found))
    df = spark.createDataFrame(rows, f"id int, matches {MATCH_TYPE}")
    for r in health.with_health(df, RULES).collect():
        ranked, risks = health_of(rows[r["id"]][1])
        assert [(d["disease"], d["probability"]) for d in r["diseases"]] == [(n, d["p"]) for n, d in ranked]
        assert [d["severity"] for d in r["diseases"]] == [["LOW", "MODERATE", "HIGH", "CRITICAL"][d["rank"]] for _, d in ranked]
        assert [d["alerts"] for d in r["diseases"]] == [d["alerts"] for _, d in ranked]
        assert [d["description"] for d in r["diseases"]] == [d["text"] for _, d in ranked]
        assert [(o["organ"], o["score"]) for o in r["organ_risks"]] == risks
        if ranked:
            top = ", ".join(f"{n} ({d['p']:.0%})" for n, d in ranked[:3])
            assert r["summary"].startswith(f"Top predicted health risks: {top}.")
        else:
            assert r["summary"].startswith("No significant")


def mixtures(spark, cases):
    """cases: list of lists of (probability, [(ord, n), ...])."""
    rows = [
        (i, [(k + 1, f"c{k}", float(p), 0.5, found) for k, (p, found) in enumerate(parts)]) for i, parts in enumerate(cases)
    ]
    return spark.createDataFrame(rows, f"id int, components {COMPONENT_TYPE}")


def scored(spark, cases):
    rows = mixture.score_components(mixtures(spark, cases), RULES, health=False).collect()
    return sorted(rows, key=lambda r: r["id"])


def test_published_component_values_escalate_to_3971(spark):
    row = scored(spark, [[(0.246, [(1, 1)]), (0.351, [(6, 1)])]])[0]
    assert row["escalated"] == 0.3971
    assert row["final_probability"] == 0.3971
    assert row["label"] == "MODERATE"
    assert "total_alert_score=0.45, normalized=0.225" in row["explanation"]


def test_pair_rules_need_two_components(spark):
    rows = scored(
        spark,
        [
            [(0.1, [(1, 1), (2, 1)]), (0.1, [])],  # both alerts in one component only
            [(0.1, [(1, 1)]), (0.1, [(2, 1)])],
            [(0.1, [(2, 1)]), (0.1, [(1, 1)])],  # either way round
            [(0.1, [(1, 1), (2, 1)]), (0.1, [(2, 1)])],
            [(0.1, [(10, 1), (1, 1)]), (0.1, [(11, 1), (2, 1)])],  # 1.50 beats 1.35
            [(0.1, [(1, 1), (3, 1)]), (0.1, [(2, 1)])],  # two rules at 1.35: the first wins
        ],
    )
    names = [r["best_rule"]["rule"] if r["best_rule"] else None for r in rows]
    assert names[0] is None
    assert names[1] == names[2] == names[3] == "Aromatic + Nitro → Carcinogenic amplification"
    assert names[4].startswith("Epoxide + Quinone")
    assert names[5] == "Aromatic + Nitro → Carcinogenic amplification"


def test_interaction_branch_order(spark):
    none = []
    rows = scored(
        spark,
        [
            [(0.1, none), (0.7, none), (0.4, none), (0.5, none)],  # contrast before moderate
            [(0.25, none), (0.4, none), (0.5, none)],
            [(0.1, [(14, 1), (15, 1), (16, 1)]), (0.1, [(14, 1), (15, 1)])],  # many alerts
            [(0.1, none), (0.2, none)],
            [(0.3, none), (0.6, none)],  # bounds are open
        ],
    )
    assert [(r["interaction"]["type"], r["interaction"]["modifier"]) for r in rows] == [
        ("ADDITIVE", 1.0), ("ADDITIVE", 1.1), ("SYNERGISTIC", 1.2), ("INDEPENDENT", 1.0), ("INDEPENDENT", 1.0),
    ]
    assert rows[0]["combined"] == round((0.1 + 0.7 + 0.4 + 0.5) / 4, 4)
    assert rows[2]["combined"] == min(round((1 - 0.9 * 0.9) * 1.2, 4), 0.999)
    assert rows[3]["combined"] == 0.2


def python_mixture(parts):
    """Straight reading of the mixture rules."""
    ps = [p for p, _ in parts]
    names = [{RULES.alerts[o - 1][1] for o, _ in found} for _, found in parts]
    best = ("INDEPENDENT", 1.0)
    for _, _, a, b, modifier, _ in RULES.pair_rules:
        for i in range(len(parts)):
            for j in range(len(parts)):
                if i != j and a in names[i] and b in names[j] and modifier > best[1]:
                    best = ("SYNERGISTIC", modifier)
    rows = sum(len(f) for _, f in parts)
    if best[0] == "INDEPENDENT":
        if min(ps) < 0.2 and max(ps) > 0.6:
            best = ("ADDITIVE", 1.0)
        elif sum(0.3 < p < 0.6 for p in ps) >= 2:
            best = ("ADDITIVE", 1.1)
        elif rows >= 5:
            best = ("SYNERGISTIC", 1.2)
    product = 1.0
    for p in ps:
        product *= 1 - p
    value = {"SYNERGISTIC": (1 - product) * best[1], "ADDITIVE": float(np.mean(ps)) * best[1]}.get(best[0], max(ps))
    combined = min(round(value, 4), 0.999)
    weight = 0.0
    for _, found in parts:
        for o, _ in found:
            weight += RULES.weights[RULES.alerts[o - 1][1]]
    escalated = 0.0
    if weight > 0:
        toxic = sum((len(f) >= 2) + (p >= 0.35) for p, f in parts)
        kinds = len(set().union(*names))
        cap = min(max(ps) + 0.15, 0.95)
        e = min(max(ps) * (1 + min(weight / len(parts) * 0.5, 0.25)), cap)
        if kinds >= 2:
            e = min(e + (cap - e) * min(0.10, 0.03 * kinds), cap)
        if toxic >= 2:
            e = min(e + (cap - e) * (0.06 if toxic == 2 else 0.10), cap)
        escalated = round(e, 4)
    return best, combined, escalated, max(combined, escalated), min(10, max(1, int(max(combined, escalated) * 10) + rows))


def test_random_mixtures_against_python(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(400):
        cases.append(
            [
                (rng.choice([0.0, 0.1, 0.35, 0.5, round(rng.random(), 4)]),
                 [(o, rng.randint(1, 3)) for o in sorted(rng.sample(range(1, 17), rng.choice([0, 0, 1, 2, 4])))])
                for _ in range(rng.randint(2, 10))
            ]
        )
    for row, parts in zip(scored(spark, cases), cases, strict=True):
        best, combined, escalated, final, danger = python_mixture(parts)
        assert (row["interaction"]["type"], row["interaction"]["modifier"]) == best
        assert row["combined"] == combined
        assert row["escalated"] == escalated
        assert row["final_probability"] == final
        assert row["danger_level"] == danger
        assert escalated <= max(p for p, _ in parts) + 0.15 + 1e-9
        top = max(range(len(parts)), key=lambda k: parts[k][0])
        assert row["most_dangerous"] == f"c{top}"


def test_component_pairs(spark):
    rows = mixtures(spark, [[(0.1, [])] * 4]).select(F.inline(mixture.component_pairs(F.col("components")))).collect()
    assert {(r["pos_a"], r["pos_b"]) for r in rows} == {(i, j) for i in range(1, 5) for j in range(i + 1, 5)}


def test_truncation_and_usability(spark):
    rows = [("one", 1, "CCO")]
    rows += [("two", i, t) for i, t in enumerate(["CCO", "C=O"])]
    rows += [("eleven", i, "CCO") for i in range(11)] + [("blank", 0, "CCO"), ("blank", 1, "  "), ("blank", 2, None)]
    rows += [("late", i, " " if i < 9 else "CCO") for i in range(30)]  # only one usable among the first ten
    rows += [("hot", i, "c1ccccc1") for i in range(3000)]
    df = spark.createDataFrame(rows, "mix string, line int, text string").repartition(6)
    out = scoring.score_mixture_rows(df, "mix", [F.col("line")], "text", F.lit(0.2), RULES).collect()
    assert {r["mix"]: len(r["components"]) for r in out} == {"two": 2, "eleven": 10, "hot": 10}
    assert [c["pos"] for c in next(r for r in out if r["mix"] == "eleven")["components"]] == list(range(1, 11))


def test_mixture_lists_count_the_first_ten(spark):
    rows = [(1, ["CCO", " ", "C=O"]), (2, [" "] * 9 + ["CCO", "C=O"]), (3, ["CCO"] * 12), (4, ["CCO"]), (5, None)]
    df = spark.createDataFrame(rows, "id int, parts array<string>")
    out = scoring.score_mixture_lists(df, "parts", RULES).collect()
    assert {r["id"]: [c["key"] for c in r["components"]] for r in out} == {1: ["CCO", "C=O"], 3: ["CCO"] * 10}


def test_rule_table_of_any_size_gives_the_same_matches(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "c1ccccc1"), (2, "CCO"), (3, "NN"), (4, "C1CO1"), (5, None)], "id int, text string")
    table = RULES.alerts_df(spark)
    direct = match.matches_long(
        texts.withColumn("matches", match.match_rules(F.col("text"), RULES)), ["id"]
    )
    expected = sorted(map(tuple, direct.collect()))
    assert expected
    assert sorted(map(tuple, match.match_rule_table(texts, ["id"], "text", table).collect())) == expected
    monkeypatch.setattr(match, "MAX_RULES", 4)  # forces several batches
    assert sorted(map(tuple, match.match_rule_table(texts, ["id"], "text", table).collect())) == expected


@pytest.mark.parametrize(
    ("structure", "alerts"),
    [
        ("CCO", set()),
        ("c1ccccc1", {"Benzene Ring"}),
        ("O", set()),
        ("CC(=O)Nc1ccc(O)cc1", {"Benzene Ring"}),
        ("[O-][N+](=O)c1ccccc1", {"Benzene Ring", "Nitro Group"}),
        ("Nc1ccccc1", {"Benzene Ring", "Aromatic Amine (Primary)"}),
        ("CC=O", {"Aldehyde"}),
        ("C=O", {"Formaldehyde-like"}),
        ("ClCCl", {"Halogenated Alkyl"}),
        ("C1CO1", {"Epoxide"}),
        ("NN", {"Hydrazine"}),
        ("O=C1C=CC(=O)C=C1", {"Quinone"}),
        ("CC(C)=O", set()),
    ],
)
def test_structure_patterns(spark, structure, alerts):
    df = spark.createDataFrame([(structure,)], "text string")
    found = match.matches_long(df.withColumn("matches", match.match_rules(F.col("text"), RULES)), ["text"]).collect()
    assert {r["alert"] for r in found} - {"Reactive α,β-Unsaturated Carbonyl"} == alerts


def test_smoke_compounds_score(spark):
    """The smoke inputs: every usable text gives a labelled row, unusable ones give none."""
    texts = ["CCO", "c1ccccc1", "CC(=O)O", "O", "CC(=O)Nc1ccc(O)cc1", "CN1CCC[C@H]1c1cccnc1", "ClC(Cl)(Cl)Cl",
             "c1ccc2cc3ccccc3cc2c1", "CC(C)(C)OC(=O)N=C=O", "", "   ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = scoring.score_entities(df, "text", RULES).collect()
    assert sorted(r["id"] for r in rows) == list(range(9))
    for r in rows:
        assert r["probability"] >= 0.5 and r["raw_probability"] == 0.5 and r["predicted_class"] == 2
        assert r["label"] in RULES.labels
        assert 0 <= r["confidence"] <= 1


def test_batch_routing(spark):
    rows = [
        (1, "benzene, aniline", "CCO"), (2, "benzene", "CCO"), (3, None, "aniline"), (4, " ", None), (5, None, None),
        (6, "CCO.C=O", None), (7, ",,", "ethanol, benzene"), (8, ", ".join(["benzene"] * 12), None),
    ]
    df = spark.createDataFrame(rows, "id int, Mixture string, smiles string")
    out = {r["id"]: r for r in scoring.batch_route(df, RULES, ["id"]).collect()}
    assert [out[i]["Mode"] for i in range(1, 9)] == [
        "Mixture", "Single", "Single", "Error", "Error", "Mixture", "Single", "Mixture"
    ]
    assert out[8]["N_Components"] == 10 and out[7]["N_Components"] == 1
    assert out[7]["Input"] == "ethanol, benzene" and out[1]["Input"] == "benzene, aniline"
    assert out[5]["Label"] == "UNKNOWN" and out[5]["Probability"] == 0 and out[5]["Interaction"] == "N/A"
    assert out[7]["Danger_Level"] == 5  # first part only: ethanol, no alert, probability 0.5
    summary = scoring.batch_summary(scoring.batch_route(df, RULES, ["id"])).first()
    assert summary["total"] == 8


def test_component_labels_use_the_unrounded_probability(spark):
    """0.79996 rounds to 0.8 but is still below the CRITICAL bound."""
    df = spark.createDataFrame([(1, "CCO", None), (2, None, "CCO, O")], "id int, smiles string, mixture string")
    base = lambda key: F.lit(0.79996)
    out = {r["id"]: r for r in scoring.batch_route(df, RULES, ["id"], base).collect()}
    assert (out[1]["Probability"], out[1]["Label"]) == (0.8, "HIGH RISK")
    assert (out[2]["Probability"], out[2]["Label"]) == (0.8, "CRITICAL")  # mixtures label the rounded value
    lines = scoring.mixture_report(scoring.score_mixture_texts(df, "mixture", RULES, base), "id").collect()
    assert [r["Label"] for r in sorted(lines, key=lambda r: r["line"])] == ["HIGH RISK", "HIGH RISK", "CRITICAL"]


def test_detect_columns():
    assert scoring.detect_columns(["SMILES", "smiles", "Mixture"]) == ("smiles", "Mixture")
    assert scoring.detect_columns(["mixture"]) == (None, "mixture")
    with pytest.raises(ValueError):
        scoring.detect_columns(["a"])


def test_rule_book_sizes_and_checks():
    assert [len(RULES.alerts), len(RULES.diseases), len(RULES.organ_scores), len(RULES.organs), len(RULES.pair_rules),
            len(RULES.weights), len(RULES.names), len(RULES.labels)] == [16, 43, 52, 15, 7, 16, 54, 5]
    with pytest.raises(ValueError):
        RuleBook(names={str(i): "C" for i in range(2000)})
    with pytest.raises(ValueError):
        RuleBook(alerts=RULES.alerts[1:])


def test_results_that_nothing_reads_are_not_computed(spark):
    """An unread column is dropped with all it needs; a read one is computed once, also below a filter on it."""
    source = spark.range(4).select("id", F.when(F.col("id") != 2, F.col("id")).alias("x"))
    total = F.aggregate(F.array("x", "x"), F.lit(1).cast("long"), lambda a, x: a + x)
    made = computed_if_read(source.withColumns({"a": total, "b": F.raise_error(F.concat(F.lit("read"), "x")).cast("string")}), ["a", "b"])
    assert [tuple(r) for r in made.select("id", "a").orderBy("id").collect()] == [(0, 1), (1, 3), (2, None), (3, 7)]
    kept = made.where("a > 2").select("id", (F.col("a") * F.col("a")).alias("square"))
    assert sorted(map(tuple, kept.collect())) == [(1, 9), (3, 49)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_a_batch_summary_needs_no_health_report(spark):
    upload = spark.createDataFrame([(1, "CCO", None), (2, None, "c1ccccc1, CCO")], "i long, smiles string, mixture string").localCheckpoint()
    batch = scoring.batch_route(upload, RULES, ["i"])

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "AS diseases" in plan(batch) and "AS organ_risks" not in plan(batch)
    assert "AS diseases" not in plan(scoring.batch_summary(batch)) and "AS explanation" not in plan(scoring.batch_summary(batch))
    assert scoring.batch_summary(batch).first()["total"] == 2

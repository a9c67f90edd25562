"""Metrics against the published confusion matrices and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import explain, features, metrics
from hazardloom.plans.evaluation import evaluation_tables
from hazardloom.rules import RuleBook

# Published test matrices (rows true, columns predicted) with their metrics.
MATRICES = {
    "XGBoost": [[1919, 64, 6, 2, 0], [289, 105, 18, 1, 0], [49, 41, 27, 5, 0], [12, 10, 6, 4, 1], [3, 2, 0, 1, 0]],
    "RandomForest": [[1841, 133, 13, 4, 0], [232, 149, 31, 1, 0], [38, 42, 37, 5, 0], [9, 8, 11, 4, 1], [2, 1, 2, 0, 1]],
    "LightGBM": [[1771, 204, 15, 1, 0], [205, 173, 31, 4, 0], [37, 47, 32, 6, 0], [9, 11, 9, 3, 1], [2, 1, 2, 1, 0]],
}
PUBLISHED = {
    "XGBoost": (0.8012, 0.7583, 0.8012, 0.7687),
    "RandomForest": (0.7922, 0.769, 0.7922, 0.7783),
    "LightGBM": (0.7715, 0.7628, 0.7715, 0.7664),
}
MACRO_F1 = {"XGBoost": 0.34132052642304966, "RandomForest": 0.4114958948595195, "LightGBM": 0.34360951933934825}


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        (m, y, p)
        for m, matrix in MATRICES.items()
        for y, line in enumerate(matrix)
        for p, n in enumerate(line)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "model string, y int, yhat int")


def test_published_metrics(spark, predictions):
    matrix = metrics.confusion_matrix(predictions, "y", "yhat", 5, ("model",))
    cells = {(r["model"], r["y"], r["yhat"]): r["n"] for r in matrix.collect()}
    assert cells == {(m, y, p): n for m, rows in MATRICES.items() for y, line in enumerate(rows) for p, n in enumerate(line)}
    scores = metrics.class_scores(matrix, ("model",))
    got = {r["model"]: tuple(r)[1:] for r in metrics.weighted_metrics(scores, ("model",)).collect()}
    assert got == PUBLISHED
    exact = metrics.weighted_metrics(scores, ("model",), digits=None).withColumn(
        "ord", F.array_position(F.array(*[F.lit(m) for m in MATRICES]), F.col("model"))
    )
    best = metrics.best_model(exact, "model", "f1_score", "ord").first()
    assert best["best_model"] == "RandomForest" and best["best_f1"] == pytest.approx(0.7782672883535345)


def test_published_report(spark, predictions):
    scores = metrics.class_scores(metrics.confusion_matrix(predictions, "y", "yhat", 5, ("model",)), ("model",))
    rows = {(r["model"], r["row"]): r for r in metrics.classification_report(scores, ("model",)).collect()}
    assert len(rows) == 3 * 8
    for model, value in MACRO_F1.items():
        assert rows[model, "macro avg"]["f1_score"] == pytest.approx(value)
        assert rows[model, "weighted avg"]["support"] == 2565
    first = rows["XGBoost", "NON-TOXIC"]
    assert first["precision"] == pytest.approx(0.8446302816901409)
    assert first["recall"] == pytest.approx(0.963837267704671)
    assert rows["XGBoost", "CRITICAL"]["precision"] == 0.0
    assert rows["LightGBM", "accuracy"]["f1_score"] == pytest.approx(0.7715399610136452)


def test_curves_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 2), [round(rng.random(), 2) for _ in range(4)]) for i in range(400)]  # class 3 has no positive
    df = spark.createDataFrame(rows, "k int, y int, scores array<double>")
    counts = metrics.threshold_counts(metrics.one_vs_rest(df, [], "y", "scores", 4), ["class"])
    auc = {r["class"]: r["auc"] for r in metrics.roc_auc(counts, ["class"]).collect()}
    ap = {r["class"]: r["average_precision"] for r in metrics.average_precision(counts, ["class"]).collect()}
    assert set(auc) == set(ap) == {0, 1, 2}
    for c in auc:
        pos = [s[c] for _, y, s in rows if y == c]
        neg = [s[c] for _, y, s in rows if y != c]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert auc[c] == pytest.approx(wins / len(pos) / len(neg))
        total, last = 0.0, 0.0
        for t in sorted({s[c] for _, _, s in rows}, reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            total += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        assert ap[c] == pytest.approx(total)
    roc = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(counts, ["class"]).where("class = 0").collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(auc[0])
    weights = {c: sum(y == c for _, y, _ in rows) for c in auc}
    mean = metrics.weighted_auc(metrics.roc_auc(counts, ["class"])).first()["roc_auc"]
    assert mean == pytest.approx(sum(auc[c] * w for c, w in weights.items()) / sum(weights.values()))


def test_auc_without_negatives_is_null(spark):
    df = spark.createDataFrame([(0, [0.4]), (0, [0.9])], "y int, scores array<double>")
    counts = metrics.threshold_counts(metrics.one_vs_rest(df, [], "y", "scores", 1), ["class"])
    assert metrics.roc_auc(counts, ["class"]).first()["auc"] is None
    assert metrics.weighted_auc(metrics.roc_auc(counts, ["class"])).first()["roc_auc"] is None


def test_evaluation_tables_shapes(spark, predictions):
    rows = predictions.limit(500).withColumn("scores", F.array(*[F.rand(i) for i in range(5)]))
    tables = evaluation_tables(rows)
    assert set(tables) == {"confusion", "roc", "pr", "areas", "comparison"}
    assert tables["confusion"].count() % 25 == 0


def test_standard_scale_population_deviation(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])], "k int, f array<double>")
    got = {r["k"]: r["scaled"] for r in features.standard_scale(df, "f").collect()}
    deviation = (2 / 3) ** 0.5
    assert got[1] == pytest.approx([-1 / deviation, 0.0]) and got[2] == pytest.approx([0.0, 0.0])


def test_matrix_median_impute_edges(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0, None), (2, nan, None), (3, inf, None), (4, 3.0, None)], "k int, a double, b double")
    got = {r["k"]: (r["a"], r["b"], r["all_missing"]) for r in features.matrix_median_impute(df, ["a", "b"]).collect()}
    assert got == {1: (1.0, 0.0, False), 2: (2.0, 0.0, True), 3: (2.0, 0.0, True), 4: (3.0, 0.0, False)}


def test_feature_table_imputes_unusable_rows(spark):
    rules = RuleBook.default()
    df = spark.createDataFrame([(1, "c1ccccc1"), (2, "c1ccccc1"), (3, "CCO"), (4, "  "), (5, None)], "k int, t string")
    table = features.feature_table(df, "k", "t", rules)
    assert {r["k"]: len(r["features"]["indices"]) for r in table.collect()}[3] < 20
    out = {r["k"]: r for r in table.withColumn("features", features.to_dense("features")).collect()}
    names = features.feature_names(rules)
    assert all(len(r["features"]) == len(names) == features.n_features(rules) for r in out.values())
    assert [out[k]["imputed"] for k in range(1, 6)] == [False, False, False, True, True]
    assert out[4]["features"] == out[5]["features"] == out[1]["features"]  # two of three rows agree
    assert out[1]["features"][names.index("rule_1")] == 1.0 and out[3]["features"][names.index("rule_1")] == 0.0
    assert out[3]["features"][names.index("n_chars")] == 3.0


def test_sparse_statistics_are_those_of_the_dense_rows(spark):
    """Zeros that are never stored count in means, deviations and medians."""
    rng = random.Random(6)
    dense = [[rng.choice([0.0, 0.0, 1.0, 2.5, -4.0]) if j % 3 else float(j == 3) for j in range(9)] for _ in range(200)]
    rows = [(i, (9, [j for j, v in enumerate(d) if v], [v for v in d if v]), d) for i, d in enumerate(dense)]
    df = spark.createDataFrame(rows, f"k int, s {features.SPARSE}, d array<double>")
    one, two = features.scaler_stats(df, "s").first(), features.scaler_stats(df, "d").first()
    for c in ("mean", "std"):
        assert one[c] == pytest.approx(two[c], abs=1e-12)
    assert all(r["x"] == r["d"] for r in df.select(features.to_dense("s").alias("x"), "d").collect())


def test_attribution_top_features_and_text(spark):
    rows = [(1, [float(i) for i in range(30)], 4), (2, [0.0] * 30, 0)]
    df = spark.createDataFrame(rows, "k int, f array<double>, c int")
    weights = spark.createDataFrame([(i, 1.0 if i % 2 else -1.0, 0.0) for i in range(30)], "feature int, weight double, mean double")
    names = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("x"), i.cast("string")))
    out = explain.row_attribution(explain.contributions(df, "f", weights), "f", names)
    rows = {r["k"]: r for r in out.withColumn("text", explain.attribution_text(F.col("attribution"), F.col("c"))).collect()}
    first = rows[1]["attribution"]
    assert [e["feature"] for e in first["risk"]] == [f"x{i}" for i in range(29, 9, -2)]
    assert [e["contribution"] for e in first["protective"]] == [-float(i) for i in range(28, 8, -2)]
    assert rows[1]["text"] == (
        "This molecule is predicted **CRITICAL**. Key risk-increasing features: **x29**, **x27**, **x25**. "
        "Protective features: **x28**, **x26**, **x24**."
    )
    assert rows[2]["attribution"]["risk"] == [] and len(rows[2]["attribution"]["protective"]) == 10


def test_best_per_metric_marks_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 0.2), ("b", 0.5, 0.1)], "model string, f1 double, acc double")
    got = {(r["model"], r["metric"]): r["is_best"] for r in metrics.best_per_metric(df, "model", ["f1", "acc"]).collect()}
    assert got == {("a", "f1"): True, ("b", "f1"): True, ("a", "acc"): True, ("b", "acc"): False}

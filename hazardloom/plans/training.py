"""Training, comparing and storing tree classifiers.

Scaler, split, trees and predictions are parts of a resumable run (:mod:`hazardloom.sources.runs`),
found again by the digest of data and settings.  The driver sees nodes, and one
metric row per model.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.functions.scores import weighted_class_score
from hazardloom.functions.text import is_usable_key
from hazardloom.operators.clean import balanced_class_weights
from hazardloom.operators.features import (
    apply_scaler,
    assemble_vector,
    feature_table,
    is_sparse,
    scaler_stats,
    sparse_features,
)
from hazardloom.operators.metrics import (
    class_scores,
    classification_report,
    confusion_matrix,
    one_vs_rest,
    roc_auc,
    threshold_counts,
    weighted_auc,
    weighted_metrics,
)
from hazardloom.operators.ordered import stratified_split
from hazardloom.operators.trees import TreeSpec
from hazardloom.plans.boosting import TreeModel, fit_trees, load_model
from hazardloom.plans.scoring import AddBases, score_entities
from hazardloom.rules import RuleBook
from hazardloom.session import computed_once, spread, write_and_read
from hazardloom.sources.files import persist_holdout, scan_json_metrics, sink_json_metrics
from hazardloom.sources.runs import RunStore, settings_digest, table_digest

# --- fixed values: the candidates' settings --------------------------------
SEED = 42
TEST_SHARE = 0.2
N_CLASSES = 5
FOREST = TreeSpec("forest", 300, max_depth=20, min_rows=2, min_split_rows=5, balanced=True, seed=SEED)
BOOSTED = TreeSpec("boosted", 300, rate=0.1, max_depth=6, min_hessian=1.0, l2=1.0, seed=SEED)
BOOSTED_BALANCED = TreeSpec("boosted", 300, rate=0.1, max_leaves=31, min_rows=20, min_hessian=1e-3, balanced=True, seed=SEED)


def forest(**settings) -> TreeSpec:
    """Random forest on balanced class weights."""
    return replace(FOREST, **settings)


def candidates(forest_settings: dict | None = None, boosted_settings: dict | None = None) -> dict[str, TreeSpec]:
    """The three candidate models by name, in comparison order."""
    return {
        "BoostedTrees": replace(BOOSTED, **(boosted_settings or {})),
        "RandomForest": forest(**(forest_settings or {})),
        "BalancedBoostedTrees": replace(BOOSTED_BALANCED, **(boosted_settings or {})),
    }


def text_training_table(df: DataFrame, key: str, text: str, cls: str, rules: RuleBook) -> DataFrame:
    """Key, class and the text features of a labelled table, such as the master table."""
    return feature_table(df, key, text, rules, (cls,)).select(key, cls, "features")


def training_rows(df: DataFrame, key: str, cls: str, features: str, scaler: DataFrame | None = None) -> DataFrame:
    """Scaled vectors with label and ``is_test``; the scaler is fitted on all rows.

    Sparse vectors stay as they are: the trees cut at ranks, which scaling leaves alone, and scaled zeros aren't zeros.
    """
    if is_sparse(df, features):
        scaled = df.withColumn("scaled", F.col(features))
    else:
        scaled = apply_scaler(df, features, scaler if scaler is not None else scaler_stats(df, features))
    rows = scaled.select(key, F.col(cls).cast("double").alias("label"), F.col("scaled"))
    return stratified_split(rows, key, "label", TEST_SHARE, SEED)


def open_run(df: DataFrame, key: str, cls: str, features: str, k: int = N_CLASSES, root: str | None = None) -> RunStore:
    """The run of a table: the same rows and split settings give the same folder in every session."""
    digest = settings_digest(table_digest(df, [key, cls, features]), key, cls, features, k, SEED, TEST_SHARE)
    return RunStore(df.sparkSession, "run", digest, root)


def run_scaler(run: RunStore, df: DataFrame, features: str) -> DataFrame:
    return run.part("scaler", lambda: scaler_stats(df, features))


def split_parts(run: RunStore, df: DataFrame, key: str, cls: str, features: str) -> tuple[DataFrame, DataFrame]:
    """Train part with class weights and test part, written once per run."""

    def make() -> DataFrame:
        # Files of an even size: a small table trains in few partitions, a large one in many.
        return training_rows(df, key, cls, features, run_scaler(run, df, features)).hint("rebalance")

    stored = run.part("split", make)
    return balanced_class_weights(stored.where(~F.col("is_test")), "label"), stored.where("is_test")


def fit(spec: TreeSpec, run: RunStore, df: DataFrame, key: str, cls: str, features: str, k: int = N_CLASSES) -> TreeModel:
    """A model on the run's train part; read back if the run has it, gone on with if it was cut off."""
    train, _ = split_parts(run, df, key, cls, features)
    weighted = train if spec.balanced else train.withColumn("weight", F.lit(1.0))
    return fit_trees(spec, weighted, key, "label", "weight", "scaled", k, run)


def predict_proba(model: TreeModel, rows: DataFrame, keep: list[str], features: str = "scaled") -> DataFrame:
    """Predicted class and class probabilities of every row of scaled features."""
    return model.predict(rows, features, keep)


def model_metrics(predictions: DataFrame, k: int = N_CLASSES, digits: int | None = 4) -> DataFrame:
    """One metric row per ``model`` from (model, y, yhat, scores) rows."""
    scores = class_scores(confusion_matrix(predictions, "y", "yhat", k, ("model",)), ("model",))
    counts = threshold_counts(one_vs_rest(predictions, ["model"], "y", "scores", k), ["model", "class"])
    auc = weighted_auc(roc_auc(counts, ["model", "class"]), ("model",))
    if digits is not None:
        auc = auc.withColumn("roc_auc", F.round("roc_auc", digits))
    return weighted_metrics(scores, ("model",), digits).join(auc, "model", "left")


@dataclass
class TrainingRun:
    """What a training run leaves behind."""

    models: dict[str, TreeModel]
    scaler: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    best: str
    best_f1: float
    sizes: dict[str, int]
    paths: dict[str, str] = field(default_factory=dict)


def train_and_evaluate(
    df: DataFrame, key: str, cls: str, features: str, specs: dict[str, TreeSpec] | None = None,
    k: int = N_CLASSES, store: str | None = None, names: list[str] | None = None, root: str | None = None,
) -> TrainingRun:
    """Split, fit every candidate on the same train part, score the test part, pick the best.

    Scaler, split, models and test predictions are parts of the run, so a second call, also in another session,
    reads them, and a call after one that was cut off goes on.  With ``store`` the scaler, the
    feature names, the hold-out, the predictions, every model, the best model and the run metadata
    are saved under it, for :func:`load_run`.
    """
    specs = specs or candidates()
    run = open_run(df, key, cls, features, k, root)
    scaler = run_scaler(run, df, features)
    train, test = split_parts(run, df, key, cls, features)
    with ThreadPoolExecutor(len(specs)) as pool:  # a small table's fits are a task each
        fits = {n: pool.submit(fit, spec, run, df, key, cls, features, k) for n, spec in specs.items()}
    models = {n: f.result() for n, f in fits.items()}

    def make() -> DataFrame:
        scored = [
            predict_proba(model, test, [key, "label"]).select(
                F.lit(name).alias("model"), F.lit(i).alias("ord"), key, F.col("label").cast("int").alias("y"), "yhat", "scores"
            )
            for i, (name, model) in enumerate(models.items())
        ]
        return reduce(DataFrame.unionByName, scored)

    predictions = run.part(f"predictions-{settings_digest([(n, asdict(s)) for n, s in specs.items()])}", make)
    exact = model_metrics(predictions, k, digits=None)
    order = {name: i for i, name in enumerate(models)}
    rows = [(r["model"], r["f1_score"]) for r in exact.select("model", "f1_score").collect()]  # one per model
    best, best_f1 = max(rows, key=lambda r: (r[1], -order[r[0]]))
    sizes = {"n_train": train.count(), "n_test": test.count(), "n_features": _length(test)}
    done = TrainingRun(models, scaler, predictions, model_metrics(predictions, k), best, best_f1, sizes)
    if store is not None:
        done.paths["holdout"] = f"{store}/holdout"
        persist_holdout(test, done.paths["holdout"])
        _store(done, store, k, names or [f"f{i}" for i in range(sizes["n_features"])])
    return done


def _length(rows: DataFrame) -> int:
    first = rows.select("scaled").first()[0]
    return first["size"] if is_sparse(rows, "scaled") else len(first)


def run_metadata(run_rows: DataFrame, head: dict[str, Column]) -> DataFrame:
    """One nested row: the head columns and a map from model to its metrics."""
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "confusion_matrix", "classification_report"]
    present = [n for n in names if n in run_rows.columns]
    packed = F.map_from_entries(F.collect_list(F.struct("model", F.struct(*present))))
    return run_rows.agg(packed.alias("results")).select(
        *[value.alias(name) for name, value in head.items()], "results"
    )


def detailed_metrics(predictions: DataFrame, k: int = N_CLASSES) -> DataFrame:
    """Metric row per model with the nested confusion matrix and report (k classes each)."""
    matrix = confusion_matrix(predictions, "y", "yhat", k, ("model",))
    lines = matrix.groupBy("model", "y").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("yhat", "n"))), lambda c: c["n"]).alias("line")
    )
    nested = lines.groupBy("model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]).alias("confusion_matrix")
    )
    report = classification_report(class_scores(matrix, ("model",)), ("model",)).where(F.col("row") != "accuracy")
    entry = F.struct(
        "row", F.struct("precision", "recall", F.col("f1_score").alias("f1-score"), F.col("support").cast("double"))
    )
    reports = report.groupBy("model").agg(F.map_from_entries(F.collect_list(entry)).alias("classification_report"))
    return model_metrics(predictions, k).join(nested, "model").join(reports, "model")


def score_with_model(
    df: DataFrame, text: str, rules: RuleBook, model: TreeModel, health: bool = True
) -> DataFrame:
    """Score usable texts with a trained model: sparse features, class probabilities, then
    :func:`hazardloom.plans.scoring.score_entities`.  No shuffle and no join."""
    keep = df.columns
    sparse = sparse_features(df.where(is_usable_key(F.col(text))), text, rules, keep)
    vectors = computed_once(sparse.select(*keep, assemble_vector(rules).alias("_features")), ["_features"])
    predicted = predict_proba(model, vectors, keep, "_features")
    return score_entities(predicted, text, rules, probabilities=F.col("scores"), health=health)


def add_model_bases(keys: list[str], rules: RuleBook, model: TreeModel) -> AddBases:
    """For mixtures and batches: base scores of component texts from a trained model.

    Every distinct text is featurised and scored once; the scores go back to the rows, told
    apart by ``keys``, through the texts' digests.
    """

    def add(df: DataFrame, parts: str, into: str) -> DataFrame:
        parted = df.select(*keys, F.posexplode(parts).alias("_pos", "_text"))
        parted = parted.withColumn("_digest", F.sha2("_text", 256))
        distinct = write_and_read(parted.groupBy("_digest").agg(F.min("_text").alias("_text")), "component-texts")
        distinct = spread(distinct, "_digest")
        sparse = sparse_features(distinct, "_text", rules, ["_digest"])
        vectors = computed_once(sparse.select("_digest", assemble_vector(rules).alias("_features")), ["_features"])
        scored = predict_proba(model, vectors, ["_digest"], "_features")
        scored = scored.select("_digest", weighted_class_score(F.col("scores")).alias("_base"))
        each = F.array_sort(F.collect_list(F.struct("_pos", "_base")))
        bases = parted.select(*keys, "_pos", "_digest").join(scored, "_digest").groupBy(*keys).agg(
            F.transform(each, lambda e: e["_base"]).alias(into)
        )
        return df.join(bases, keys, "left")

    return add


def feature_importance(model: TreeModel, names: list[str]) -> DataFrame:
    """``feature, name, importance``: each feature's share of all gains, a row per feature."""
    gains = model.nodes.where("feature is not null").groupBy("feature").agg(F.sum("gain").alias("gain"))
    named = model.nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    total = gains.agg(F.sum("gain")).scalar()
    share = F.coalesce(F.col("gain") / total, F.lit(0.0))
    return named.join(gains, "feature", "left").select("feature", "name", share.alias("importance"))


@dataclass
class StoredRun:
    """A run read back from its folder."""

    best: str
    model: TreeModel
    scaler: DataFrame
    names: list[str]
    holdout: DataFrame
    predictions: DataFrame
    metadata: DataFrame


def load_run(spark: SparkSession, folder: str) -> StoredRun | None:
    """Everything that later jobs need of a stored run; None if there is none."""
    metadata = scan_json_metrics(spark, f"{folder}/training_meta")
    head = metadata.select("best_model").first()
    if head is None:
        return None
    names = spark.read.parquet(f"{folder}/feature_names").orderBy("feature").select("name").collect()  # one per feature
    return StoredRun(
        head["best_model"],
        load_model(spark, f"{folder}/best_model"),
        spark.read.parquet(f"{folder}/scaler"),
        [r["name"] for r in names],
        spark.read.parquet(f"{folder}/holdout"),
        spark.read.parquet(f"{folder}/predictions"),
        metadata,
    )


def load_models(spark: SparkSession, folder: str) -> dict[str, TreeModel]:
    """Every stored model of a run by name; none where there is no run."""
    names = scan_json_metrics(spark, f"{folder}/training_meta").select(F.explode(F.map_keys("results")).alias("name"))
    return {r["name"]: load_model(spark, f"{folder}/{r['name']}_model") for r in names.collect()}  # one per model


def predict_stored(spark: SparkSession, folder: str, rounds: int | None = None) -> DataFrame:
    """``model, y, yhat, scores`` of the stored hold-out by every stored model, for evaluation in a later session.

    With ``rounds`` the models are cut to their first rounds.
    """
    models = load_models(spark, folder)
    if not models:
        raise ValueError(f"no stored run in {folder}")
    holdout = spark.read.parquet(f"{folder}/holdout")
    scored = [
        predict_proba(model if rounds is None else model.upto(rounds), holdout, ["label"]).select(
            F.lit(name).alias("model"), F.col("label").cast("int").alias("y"), "yhat", "scores"
        )
        for name, model in sorted(models.items())
    ]
    return reduce(DataFrame.unionByName, scored)


def _store(run: TrainingRun, folder: str, k: int, names: list[str]) -> None:
    run.paths["scaler"] = f"{folder}/scaler"
    run.scaler.write.mode("overwrite").parquet(run.paths["scaler"])
    run.paths["predictions"] = f"{folder}/predictions"
    run.predictions.write.mode("overwrite").parquet(run.paths["predictions"])
    run.paths["feature_names"] = f"{folder}/feature_names"
    spark = run.scaler.sparkSession
    spark.createDataFrame(list(enumerate(names)), "feature int, name string").write.mode("overwrite").parquet(
        run.paths["feature_names"]
    )
    for name, model in run.models.items():
        run.paths[name] = f"{folder}/{name}_model"
        model.save(run.paths[name])
    run.paths["best"] = f"{folder}/best_model"
    run.models[run.best].save(run.paths["best"])
    head = {
        "best_model": F.lit(run.best),
        "best_f1": F.lit(run.best_f1),
        "n_classes": F.lit(k),
        "n_features": F.lit(run.sizes["n_features"]),
        "n_train": F.lit(run.sizes["n_train"]),
        "n_test": F.lit(run.sizes["n_test"]),
        "feature_names_file": F.lit("feature_names"),
        "scaler_file": F.lit("scaler"),
    }
    run.paths["metadata"] = f"{folder}/training_meta"
    sink_json_metrics(run_metadata(detailed_metrics(run.predictions, k), head), run.paths["metadata"])
